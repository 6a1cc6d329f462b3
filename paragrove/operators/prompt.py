"""Evidence blocks, citation whitelists and prompts, assembled set-wise for many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("Standard", "Guidance", "Option", "Support")
STYLES = ("zeroshot", "oneshot", "fewshot", "cot")
INTRO = "Answer the question from the provisions below alone. Cite every provision you use."
RULES = "Cite only entries of the list of allowed citations. Say so where the provisions do not answer the question."
REASON = "Think step by step: list the provisions that apply, then the rule with the strongest wording, then answer."
#: Short worked examples for the one-shot and few-shot styles.
EXAMPLES = (
    ("May the sign be omitted?", "Yes, as an option [Section 1A.01 Option §3]."),
    ("Who must inspect it?", "The road agency shall [Section 1A.02 Standard §1]."),
    ("Is lighting required?", "It should be provided at night [Section 1A.03 Guidance §2]."))


def provision(c: str = "") -> Column:
    """One evidence entry."""
    col = lambda n: F.col(c + n)
    head = F.concat(F.lit("[Section "), F.coalesce(col("section_id"), F.lit("?")), F.lit(" §"), F.coalesce(col("ordinal").cast("string"), F.lit("?")), F.lit(" — "), F.coalesce(col("section_title"), F.lit("")), F.lit(" (p."), F.coalesce(F.nullif(col("page_printed"), F.lit("")), F.lit("?")), F.lit(")]"))
    return F.concat(head, F.lit("\n"), F.coalesce(col("text"), F.lit("")))


def evidence(hits: DataFrame) -> DataFrame:
    """qid, evidence: provisions grouped by rule type in fixed order, in rank order inside a group.

    hits: qid, rank, kind, section_id, ordinal, section_title, page_printed, text; an unknown kind comes last.
    """
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("kind")), F.lit(0)), F.lit(9))
    blocks = hits.withColumn("o", order).groupBy("qid", "o", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", provision().alias("p")))).alias("ps"))
    body = F.concat(F.lit("=== "), F.col("kind"), F.lit(" provisions ===\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n"))
    return blocks.select("qid", "o", body.alias("b")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "\n").alias("evidence"))


def whitelist(hits: DataFrame) -> DataFrame:
    """qid, allowed: the citations that an answer may use, in rank order."""
    cite = F.concat(F.lit("Section "), F.coalesce("section_id", F.lit("?")), F.lit(" "), "kind", F.lit(" §"), F.coalesce(F.col("ordinal").cast("string"), F.lit("?")), F.lit(" (p."), F.coalesce(F.nullif("page_printed", F.lit("")), F.lit("?")), F.lit(")"))
    return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cite.alias("c")))), lambda x: x["c"]).alias("allowed"))


def visual_line(n: Column, figure_id: Column, page: Column, caption: Column) -> Column:
    """One line for an image."""
    return F.concat(F.lit("[Image "), n.cast("string"), F.lit("] "), F.coalesce(figure_id, F.lit("?")), F.lit(" (p."), F.coalesce(F.nullif(page, F.lit("")), F.lit("?")), F.lit("): "), F.substring(F.coalesce(caption, F.lit("")), 1, 160))


def examples(n: int) -> str:
    """The first n worked examples."""
    return "\n".join(f"Q: {q}\nA: {a}" for q, a in EXAMPLES[:max(1, min(n, len(EXAMPLES)))])


def assemble(style: str, question: Column, evidence_text: Column, allowed: Column, shots: int = 3) -> Column:
    """The prompt of a style; an unknown style is taken as zero-shot."""
    parts = [F.lit(INTRO)]
    if style in ("oneshot", "fewshot"):
        parts.append(F.lit(examples(1 if style == "oneshot" else shots)))
    if style == "cot":
        parts.append(F.lit(REASON))
    return F.concat_ws("\n\n", *parts, evidence_text, F.concat(F.lit("Allowed citations:\n- "), F.array_join(allowed, "\n- ")), F.lit(RULES), F.concat(F.lit("Question: "), question))
