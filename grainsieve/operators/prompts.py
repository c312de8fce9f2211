"""Default prompts of judges whose answers have several parts: what to look at and how to answer.

``{field}`` marks are filled with the mapped columns of the record; pass ``prompt`` in a judge's settings for your own.
"""

from __future__ import annotations

from ..functions.fixed import SKILL_SYNONYMS


def ask(task: str, shape: str, *fields: tuple[str, str]) -> str:
    """A task, the shape of the answer, and the record's fields under their names."""
    given = "\n\n".join(f"{title}:\n{{{field}}}" for field, title in fields or (("content", "Text"),))
    return f"{task}\nAnswer with {shape} and nothing else.\n\n{given}"


def json(keys: str) -> str:
    return f"one JSON object with {keys}"


QUESTION, ANSWER, CONTEXTS = ("prompt", "Question"), ("content", "Answer"), ("content", "Contexts")
BETTER = "score (1 if the first extraction is better, 2 if the second is, 0 if they are alike)"
COMPARE = "Two tools extracted the same page. Say which result keeps more of the page's own {what}."
FAULTS = "errors, a list of objects with error_category, error_label and eval_details"

PROMPTS = {
    "LLMInstructionClarity": ask("Rate from 0 to 10 how clear and complete this instruction is.", json("score and reason")),
    "LLMTaskDifficulty": ask("Rate from 0 to 10 how hard this task is.", json("difficulty_score, difficulty_level and reason")),
    "LLMRAGFaithfulness": ask("Split the answer into statements and say of each whether the question's contexts support it (1) or not (0). "
                              "The score, 0 to 10, is ten times the share supported.",
                              json("score and statements, a list of objects with statement, verdict and reason"), QUESTION, ANSWER),
    "LLMRAGContextRecall": ask("Split the reference answer into statements and say of each whether it can be attributed to the contexts (1) or not (0).",
                               json("classifications, a list of objects with statement, attributed and reason"), QUESTION, ("content", "Reference answer")),
    "LLMRAGContextRelevancy": ask("Rate whether the contexts hold what the question needs: 0 nothing, 1 part of it, 2 all of it.",
                                  json("rating"), QUESTION, CONTEXTS),
    "LLMRAGContextPrecision": ask("Say of each numbered context, in its order, whether it helps to answer the question (1) or not (0).",
                                  json("verdicts, a list of objects with verdict and reason"), QUESTION, CONTEXTS),
    "LLMRAGAnswerRelevancy": ask("Write three questions that this answer would answer, and give each one's likeness (0 to 1) to the question asked "
                                 "and whether the answer is noncommittal (1) or not (0).",
                                 json("questions, a list of objects with question, similarity and noncommittal"), QUESTION, ANSWER),
    "LLMHallucination": ask("Say of each statement of this response whether its contexts agree (yes) or contradict it (no).",
                            json("verdicts, a list of objects with verdict and reason")),
    "LLMFactCheckPublic": ask("List the factual claims of the response and check each: true, false or unsure.",
                              json("claims, a list of objects with claim, answer and reasoning"), ("prompt", "Question"), ("content", "Response")),
    "ArticleFactChecker": ask("List the checkable claims of this article and verify each: TRUE, FALSE or UNVERIFIABLE.",
                              json("claims, a list of objects with claim, verification_result and reasoning")),
    "LLMPerspective": ask("Rate from 0 to 1 how toxic, insulting, threatening, profane and hateful this text is.",
                          json("TOXICITY, INSULT, THREAT, PROFANITY and IDENTITY_ATTACK")),
    "LLMSecurityPolitics": ask("Mark each political topic that you find in this text.", json("a key for each topic and pos or neg as its value")),
    "LLMSecurityProhibition": ask("Mark each kind of forbidden content that you find in this text.", json("a key for each kind and pos or neg as its value")),
    "LLMHtmlExtractCompare": ask(COMPARE.format(what="main text"), json(f"{BETTER}, type, name and reason")),
    "LLMHtmlExtractCompareEn": ask(COMPARE.format(what="main text"), json(f"{BETTER}, type, name and reason")),
    "LLMHtmlExtractCompareV2": ask("Two tools extracted the same page. Judge the differences: A if the first is better, B if they are alike, C if the "
                                   "second is better.", "your reasons and then <Judgement>A</Judgement>, <Judgement>B</Judgement> or <Judgement>C</Judgement>"),
    "LLMCodeCompare": ask(COMPARE.format(what="code"), json(f"{BETTER}, no_code (true if the page has none) and reason")),
    "LLMMathCompare": ask(COMPARE.format(what="formulas"), json(f"{BETTER}, no_formula (true if the page has none) and reason")),
    "LLMTableCompare": ask(COMPARE.format(what="tables"), json(f"{BETTER}, no_table (true if the page has none) and reason")),
    "VLMDocumentParsing": ask("Name the faults of this rendering of a document page.", json(FAULTS)),
    "VLMDocumentParsingOCRTrain": ask("Name the faults of this recognised document page.", json(FAULTS)),
    "LLMMinerURecognizeQuality": ask("Name the faults of this recognised text.", json(FAULTS)),
    "VLMLayoutQuality": ask("Name the faults of this page layout.", json(FAULTS)),
    "LLMResumeQuality": ask("Judge this resume.", json("score (1 good, 0 bad), type, name and reason")),
    "LLMKeywordMatcher": ask("List the skills that the job asks for, how much each matters (Required, Nice-to-have or Excluded) and whether "
                             "the resume has it (Matched, Partial or Missing). These names mean the same: "
                             + "; ".join(f"{k} = {v}" for k, v in SKILL_SYNONYMS.items()) + ".",
                             json("keyword_analysis, a list of objects with keyword, importance and match_status"),
                             ("prompt", "Job description"), ("content", "Resume")),
    "LLMLongVideoQa": ask("Write questions on this video summary, with their answers.", json("question and answer lists")),
    "LLMScout": ask("Name companies that fit this profile and rate the fit from 0 to 1.",
                    json("target_companies, a list of objects with name, match_score, financial_status and scoring_breakdown"),
                    ("prompt", "Profile"), ("content", "Industry report")),
    "AgentFactCheck": ask("Check the facts of this response.", "a line HALLUCINATION_DETECTED: YES or HALLUCINATION_DETECTED: NO, then your reasons"),
}
