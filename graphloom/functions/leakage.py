"""Filters for descriptions that give a label away.

Patterns run in order on the progressively filtered text, then five clean-ups.
All are column expressions; a description never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Explicit labels that go, with the reason recorded for each.
FORBIDDEN = (
    (r"\b(is|are)\s+(a\s+)?(haploinsufficient|haplosufficient)\s*(gene)?\b", "explicit dosage label"),
    (r"\b(is|are)\s+(a\s+)?dosage[- ]?(sensitive|insensitive)\b", "explicit dosage label"),
    (r"\bthis\s+gene\s+is\s+(not\s+)?(dosage[- ]?)?(sensitive|insensitive)\b", "explicit dosage answer"),
    (r"\b(is|are)\s+(a\s+|an\s+)?(essential|non-?essential)\s+gene\b", "explicit essentiality label"),
    (r"\bthis\s+(gene\s+)?is\s+(an?\s+)?essential\b", "explicit essentiality"),
    (r"\bthis\s+gene\s+is\s+(not\s+)?essential\b", "explicit essentiality answer"),
    (r"\b(is|are)\s+(a\s+)?(specific\s+)?marker\s+(for|of)\s+\w+\s*(cells?)?\b", "explicit marker label"),
    (r"\bthis\s+gene\s+is\s+(a\s+)?marker\s+for\b", "explicit marker answer"),
    (r"\b(is|are|has)\s+(a\s+)?bivalent\s+(chromatin\s+)?(state|domain|promoter)?\b", "explicit bivalent label"),
    (r"\bthis\s+gene\s+(has|is)\s+(not\s+)?bivalent\b", "explicit bivalent answer"),
    (r"\b(is|are)\s+(a\s+)?(known\s+)?(oncogene|tumor\s+suppressor)\b", "explicit gene type"),
    (r"\bI\s+(predict|believe|think|conclude)\s+(that\s+)?(this|it|the)\b", "speculation"),
    (r"\b(yes|no),?\s+(this\s+gene\s+)?(is|does|will|can)\b", "direct answer"),
)
# Facts that stay, as signals.
SIGNALS = (
    (r"\binvolved\s+in\s+\w+", "biological process - OK"),
    (r"\bparticipates\s+in\s+\w+", "pathway participation - OK"),
    (r"\bregulates\s+\w+", "regulatory role - OK"),
    (r"\bhub\s+(gene|protein|node)\b", "network centrality - OK"),
    (r"\bhighly\s+connected\b", "connectivity - OK"),
    (r"\bcentral\s+(role|position)\b", "centrality - OK"),
    (r"\bhighly\s+conserved\b", "conservation - OK"),
    (r"\bevolutionarily\s+conserved\b", "conservation - OK"),
    (r"\bexpressed\s+in\s+\w+", "expression pattern - OK"),
    (r"\bhigh(ly)?\s+express(ed|ion)\b", "expression level - OK"),
    (r"\benriched\s+in\s+\w+", "enrichment - OK"),
    (r"\bH3K\d+me\d\b", "histone mark - OK"),
    (r"\bchromatin\s+accessibility\b", "chromatin state - OK"),
    (r"\bpromoter\s+region\b", "genomic feature - OK"),
    (r"\bkinase\s+activity\b", "enzymatic activity - OK"),
    (r"\bbinding\s+(domain|site|capacity)\b", "structural feature - OK"),
    (r"\bsignaling\s+pathway\b", "pathway - OK"),
    (r"\bclassified\s+as\s+(a\s+)?\w+", "functional classification - OK"),
    (r"\bprobability\b", "statistical term - OK"),
)
# An answer that only the pair tasks give away, and the clean-ups.
PAIR_ANSWER = r"\b(does|will)\s+(not\s+)?interact\s+with\b"
CLEANUPS = ((r"\s+", " "), (r"\.\s*\.", "."), (r",\s*,", ","), (r"^\s*[,\.]\s*", ""), (r"\s*[,\.]\s*$", "."))


#: What a text must hold for any forbidden pattern to match in it, now or after others went.
ANY = r"(?i)haplo|dosage|essential|marker|bivalent|oncogene|suppressor|sensitive|\b(?:predict|believe|think|conclude)|\b(?:yes|no),?\s"


def _any_case(pattern: str) -> str:
    return "(?i)" + pattern


def filtered(df: DataFrame, text: str = "text", strict: bool = True, task: str | None = None) -> DataFrame:
    """df with filtered, changes and reasons (one for each pattern that hit)."""
    out = df.withColumn("_t0", F.coalesce(F.col(text), F.lit("")))
    # most texts hold none of the patterns' words: one search spares them all others
    out = out.withColumn("_any", F.regexp_like("_t0", F.lit(ANY)))
    hits = []
    for k, (pattern, reason) in enumerate(FORBIDDEN):
        before, p = F.col(f"_t{k}"), _any_case(pattern)
        out = out.withColumn(f"_t{k + 1}", F.when(F.col("_any"), F.regexp_replace(before, p, "")).otherwise(before) if strict else before)
        # counted only where something went
        out = out.withColumn(f"_n{k}", F.when(F.octet_length(f"_t{k + 1}") < F.octet_length(before), F.regexp_count(before, F.lit(p))).otherwise(0))
        hits.append(F.when(F.col(f"_n{k}") > 0, F.lit(reason)))
    body = F.col(f"_t{len(FORBIDDEN)}")
    for pattern, by in CLEANUPS:
        body = F.regexp_replace(body, pattern, by)
    body = F.trim(body)
    count = sum((F.col(f"_n{k}") for k in range(len(FORBIDDEN))), F.lit(0))
    reasons = F.array_compact(F.array(*hits))
    if not strict:
        count, reasons = F.lit(0), F.array().cast("array<string>")
    out = out.withColumn("filtered", body).withColumn("changes", count.cast("long")).withColumn("reasons", reasons)
    if task in ("ppi", "ggi"):
        more = F.regexp_like("filtered", F.lit(_any_case(PAIR_ANSWER)))
        out = out.withColumn("_more", more).withColumn("changes", F.col("changes") + F.col("_more").cast("long"))
        out = out.withColumn("reasons", F.when(F.col("_more"), F.array_append("reasons", F.lit(f"explicit {task.upper()} answer"))).otherwise(F.col("reasons")))
        out = out.withColumn("filtered", F.trim(F.regexp_replace("filtered", _any_case(PAIR_ANSWER), ""))).drop("_more")
    return out.drop("_any", *[f"_t{k}" for k in range(len(FORBIDDEN) + 1)], *[f"_n{k}" for k in range(len(FORBIDDEN))])


def issues(text: Column) -> Column:
    """Reasons for which the raw text is not safe."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(_any_case(p))), F.lit(r)) for p, r in FORBIDDEN]))


def is_safe(text: Column) -> Column:
    return F.size(issues(text)) == 0


def signals(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(_any_case(p))), F.lit(r)) for p, r in SIGNALS]))
