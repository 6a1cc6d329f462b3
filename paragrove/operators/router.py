"""The question router: whether a question needs figures, by one select of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signal vocabularies.
EXPLICIT_ID = r"(?i)\b(Figure|Table)\s+[0-9]+[A-Z]{0,2}[-‐-—]\d+\b"
VISUAL_VERB = r"(?i)\b(show(?:\s+me)?|look\s+like|looks\s+like|diagram|illustrat\w*|draw(?:ing)?|picture|image|photo|depict\w*|appearance|visual\w*|what\s+color|what\s+shape|layout\s+of|example\s+of\s+a?\s*sign)\b"
VISUAL_NOUN = r"(?i)\b(sign|signs|plaque|marking|markings|signal\s+(?:face|head|indication)s?|beacon|crosswalk|arrow|symbol|legend|stripe|chevron|delineator|barricade|channelizing|cone|gate|pavement\s+word)\b"
SIGN_CODE = r"\b[RWDIMOE][A-Z]?\d{1,3}(?:-\d{1,3})?[a-zA-Z]?P?\b"
PLACEMENT = r"(?i)\b(placed?|placement|locat\w+|position\w*|mount\w+|install\w+|arrang\w+|spacing|where\s+should)\b"
TEXTUAL = r"(?i)\b(what\s+does\s+.{1,40}\bmean|meaning\s+of|defin\w+|when\s+(?:is|are|shall|should|may|must)|is\s+it\s+(?:required|permitted|allowed)|(?:minimum|maximum)\s+(?:height|width|size|distance|spacing|speed|time)|how\s+(?:far|tall|wide|long|many\s+(?:feet|inches|seconds))|who\s+(?:is|has)\s+(?:responsible|authority)|purpose\s+of)\b"
#: The soft scores.
CODE, NOUN, TEXT, PLACE, PRIOR, THRESHOLD = 0.45, 0.30, -0.35, 0.15, 0.35, 0.5


def route(questions: DataFrame, question: str = "question", prior: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """questions with needs_figures, confidence, max_figures, soft_score and rules_fired.

    prior: a column with the share of the best sections that cite figures; null counts as no prior. A null question fires no
    rule and needs no figures.
    """
    q = F.coalesce(F.trim(question), F.lit(""))
    frac: Column = F.coalesce(F.col(prior), F.lit(0.0)) if prior else F.lit(0.0)
    one = lambda p, w: F.when(q.rlike(p), F.lit(w)).otherwise(0.0)
    score = one(SIGN_CODE, CODE) + one(VISUAL_NOUN, NOUN) + one(TEXTUAL, TEXT) + one(PLACEMENT, PLACE) + PRIOR * frac
    explicit, verb = q.rlike(EXPLICIT_ID), q.rlike(VISUAL_VERB)
    no = q.rlike(TEXTUAL) & ~q.rlike(VISUAL_NOUN) & ~q.rlike(SIGN_CODE)
    soft = F.round(score, 6) >= threshold
    needs = F.when(explicit | verb, True).when(no, False).otherwise(soft)
    fired = F.filter(F.array(
        F.when(q.rlike(SIGN_CODE), "sign_code"), F.when(q.rlike(VISUAL_NOUN), "visual_noun"), F.when(q.rlike(TEXTUAL), "textual_pattern"), F.when(q.rlike(PLACEMENT), "placement_verb"),
        F.when(frac > 0, "kg_prior"), F.when(soft, "soft:yes").otherwise("soft:no")), lambda r: r.isNotNull())
    return questions.withColumns({
        "needs_figures": needs,
        "confidence": F.round(F.when(explicit, 0.99).when(verb, 0.95).when(no, 0.9).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(score - threshold))), 6),
        "max_figures": F.when(explicit | verb, 4).when(no, 0).otherwise(F.when(soft, 3).otherwise(0)),
        "soft_score": F.round(F.when(explicit | verb | no, 0.0).otherwise(score), 6),
        "rules_fired": F.when(explicit, F.array(F.lit("hard_yes:explicit_figure_id"))).when(verb, F.array(F.lit("hard_yes:visual_verb"))).when(no, F.array(F.lit("hard_no:textual_pattern_no_visual_evidence"))).otherwise(fired)})
