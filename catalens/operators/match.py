"""Dictionary matching: score tables against names and free text.

A score table has columns ``(name, score, ord)``; ``ord`` breaks ties. Joins
carry no broadcast hint: adaptive execution broadcasts a score table whose
measured size allows it and shuffles a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import bins, specs
from catalens.functions import text as tx
from catalens.operators.clean import with_once
from catalens.session import staged

GRAM = 4

# ---- fixed values -----------------------------------------------------------
MIN_MATCH = 0.1
CPU_DEFAULT = 3000
GPU_DEFAULT = 500
# (pattern, family key, model name with {} for the captured groups)
CPU_RULES = [
    (r"intel\s+core\s+i3[-\s](\d{4}[a-z0-9]+)", "core i3", "core i3-{}"),
    (r"i3[-\s](\d{4}[a-z0-9]+)", "core i3", "core i3-{}"),
    (r"intel\s+core\s+i5[-\s](\d{4}[a-z0-9]+)", "core i5", "core i5-{}"),
    (r"i5[-\s](\d{4}[a-z0-9]+)", "core i5", "core i5-{}"),
    (r"intel\s+core\s+i7[-\s](\d{4}[a-z0-9]+)", "core i7", "core i7-{}"),
    (r"i7[-\s](\d{4}[a-z0-9]+)", "core i7", "core i7-{}"),
    (r"intel\s+core\s+i9[-\s](\d{4}[a-z0-9]+)", "core i9", "core i9-{}"),
    (r"i9[-\s](\d{4}[a-z0-9]+)", "core i9", "core i9-{}"),
    (r"intel\s+celeron[-\s]([a-z0-9]+)", "celeron", "celeron {}"),
    (r"celeron[-\s]([a-z0-9]+)", "celeron", "celeron {}"),
    (r"intel\s+pentium[-\s]([a-z0-9\s]+)", "pentium", "pentium {}"),
    (r"pentium[-\s]([a-z0-9\s]+)", "pentium", "pentium {}"),
    (r"amd\s+ryzen\s+(\d+)[-\s](\d{4}[a-z]?)", "ryzen", "ryzen {} {}"),
    (r"ryzen\s+(\d+)[-\s](\d{4}[a-z]?)", "ryzen", "ryzen {} {}"),
    (r"amd\s+athlon[-\s]([a-z0-9]+)", "athlon", "athlon {}"),
    (r"athlon[-\s]([a-z0-9]+)", "athlon", "athlon {}"),
    (r"amd\s+a(\d+)[-\s]([a-z0-9]+)", "a6", "a{}-{}"),
    (r"a(\d+)[-\s]([a-z0-9]+)", "a6", "a{}-{}"),
    (r"apple\s+m(\d+)", "m1", "m{}"),
    (r"m(\d+)", "m1", "m{}"),
    (r"intel\s+core\s+i(\d+)[-\s](\d{4}[a-z0-9]+)", "core i{}", "core i{}-{}"),
    (r"core\s+i(\d+)[-\s](\d{4}[a-z0-9]+)", "core i{}", "core i{}-{}"),
    (r"amd\s+ryzen\s+(\d+)\s+(\d{4}[a-z]?)", "ryzen", "ryzen {} {}"),
    (r"ryzen\s+(\d+)\s+(\d{4}[a-z]?)", "ryzen", "ryzen {} {}"),
]
GPU_RULES = [
    (r"intel\s+uhd\s+graphics\s*(\d*)", "intel uhd graphics", "intel uhd graphics {}"),
    (r"uhd\s+graphics\s*(\d*)", "intel uhd graphics", "intel uhd graphics {}"),
    (r"intel\s+iris\s+xe\s+graphics\s*([a-z0-9]*)", "intel iris xe graphics", "intel iris xe graphics {}"),
    (r"iris\s+xe\s+graphics\s*([a-z0-9]*)", "intel iris xe graphics", "intel iris xe graphics {}"),
    (r"amd\s+radeon\s+vega\s*(\d+)", "amd radeon vega", "amd radeon vega {}"),
    (r"radeon\s+vega\s*(\d+)", "amd radeon vega", "amd radeon vega {}"),
    (r"(amd\s+radeon\s+graphics)", "amd radeon graphics", "amd radeon graphics {}"),
    (r"(radeon\s+graphics)", "amd radeon graphics", "amd radeon graphics {}"),
    (r"nvidia\s+geforce\s+gtx\s*(\d{4}[a-z]*)", "geforce gtx", "geforce gtx {}"),
    (r"geforce\s+gtx\s*(\d{4}[a-z]*)", "geforce gtx", "geforce gtx {}"),
    (r"gtx\s*(\d{4}[a-z]*)", "geforce gtx", "geforce gtx {}"),
    (r"nvidia\s+geforce\s+rtx\s*(\d{4}[a-z]*)", "geforce rtx", "geforce rtx {}"),
    (r"geforce\s+rtx\s*(\d{4}[a-z]*)", "geforce rtx", "geforce rtx {}"),
    (r"rtx\s*(\d{4}[a-z]*)", "geforce rtx", "geforce rtx {}"),
    (r"nvidia\s+quadro\s*([a-z0-9]+)", "quadro", "quadro {}"),
    (r"quadro\s*([a-z0-9]+)", "quadro", "quadro {}"),
    (r"amd\s+radeon\s+rx\s*(\d{4}[a-z]*)", "radeon rx", "radeon rx {}"),
    (r"radeon\s+rx\s*(\d{4}[a-z]*)", "radeon rx", "radeon rx {}"),
    (r"rx\s*(\d{4}[a-z]*)", "radeon rx", "radeon rx {}"),
    (r"amd\s+radeon\s+pro\s*(\d{4}[a-z]*)", "radeon pro", "radeon pro {}"),
    (r"radeon\s+pro\s*(\d{4}[a-z]*)", "radeon pro", "radeon pro {}"),
]
CPU_KEYWORDS = [
    ("core i3", ["i3", "core i3"]),
    ("core i5", ["i5", "core i5"]),
    ("core i7", ["i7", "core i7"]),
    ("core i9", ["i9", "core i9"]),
    ("ryzen 3", ["ryzen 3"]),
    ("ryzen 5", ["ryzen 5"]),
    ("ryzen 7", ["ryzen 7"]),
    ("ryzen 9", ["ryzen 9"]),
    ("celeron", ["celeron"]),
    ("athlon", ["athlon"]),
    ("pentium", ["pentium"]),
    ("ryzen", ["ryzen"]),
]
GPU_KEYWORDS = [
    ("intel uhd graphics", ["uhd", "intel uhd"]),
    ("intel iris xe graphics", ["iris xe", "intel iris"]),
    ("amd radeon vega", ["radeon vega", "vega"]),
    ("amd radeon graphics", ["radeon", "amd radeon"]),
    ("geforce gtx", ["gtx", "geforce gtx"]),
    ("geforce rtx", ["rtx", "geforce rtx"]),
    ("quadro", ["quadro"]),
    ("radeon rx", ["rx", "radeon rx"]),
    ("radeon pro", ["radeon pro"]),
]
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class TextRules:
    """Everything that differs between processors and graphics."""

    rules: Sequence[tuple[str, str, str]]
    keywords: Sequence[tuple[str, Sequence[str]]]
    default: int
    strip: bool


CPU = TextRules(CPU_RULES, CPU_KEYWORDS, CPU_DEFAULT, strip=False)
GPU = TextRules(GPU_RULES, GPU_KEYWORDS, GPU_DEFAULT, strip=True)


def _rarest_grams(patterns: DataFrame, gram: int) -> DataFrame:
    """Per name, the one of its n-grams that the fewest names share.

    A name shorter than ``gram`` is its own key.
    """
    own = F.when(F.length("low") < gram, F.array("low")).otherwise(F.array_distinct(tx.grams(F.col("low"), gram)))
    keys = patterns.where(F.length("low") > 0).select("*", F.explode(own).alias("gram"))
    shared = keys.groupBy("gram").agg(F.count("*").alias("shared"))
    return (
        keys.join(shared, "gram")
        .groupBy("pattern", "low", "ord")
        .agg(F.min_by("gram", F.struct("shared", "gram")).alias("gram"))
    )


def pattern_hits(texts: DataFrame, key: str, text: str, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(key, pattern, ord, hits, size)`` for every dictionary name inside a text.

    Exact and without a text-by-dictionary product: a name can only occur in a
    text that holds the name's rarest n-gram, so text and names meet in an
    equi-join on n-grams and `contains` settles the rest. Whether the dictionary
    is sent to the tasks or shuffled is left to adaptive execution.
    """
    names = patterns.select(F.col("name").alias("pattern"), F.lower("name").alias("low"), "ord")
    keyed = staged(_rarest_grams(names, gram), "dictionary")
    widths = [F.coalesce(F.bool_or(F.length("low") == w), F.lit(False)) for w in range(1, gram)]
    lengths = keyed.agg(F.array(*widths)).first()[0]
    # Dealt by key, as the join below wants them, so that a small file of many texts keeps all tasks busy.
    base = texts.select(F.col(key), F.lower(text).alias("__text")).where(F.length("__text") > 0).repartition(F.col(key))
    body = F.col("__text")
    kinds = [w for w in range(1, gram) if lengths[w - 1]] + [gram]
    found = F.array_distinct(F.concat(*[tx.grams(body, w) for w in kinds]))

    pairs = base.select(key, F.explode(found).alias("gram")).join(keyed, "gram").drop("gram").distinct()
    met = pairs.join(base, key)
    return met.where(body.contains(F.col("low"))).select(
        key, "pattern", "ord", tx.count_occurrences(body, F.col("low")).alias("hits"), F.length(body).alias("size")
    )


def best_match(texts: DataFrame, key: str, text: str, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """Best dictionary name per text by covered share of the text; first in order wins ties.

    Texts without any name are absent. Names that differ only in case are one
    name, the first in order, so repeated names are not matched again.
    """
    patterns = patterns.groupBy(F.lower("name")).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    hits = pattern_hits(texts, key, text, patterns, gram)
    share = F.length("pattern") * F.col("hits") / F.col("size")
    return hits.groupBy(key).agg(
        F.max_by("pattern", F.struct(share, -F.col("ord"))).alias("best_pattern"), F.max(share).alias("match_score")
    )


def score_lookup(
    names: DataFrame,
    key: str,
    name: str,
    scores: DataFrame,
    kind: str = "cpu",
    paged: DataFrame | None = None,
) -> DataFrame:
    """``(key, name, score, source)`` by exact name, best match, captured page, default.

    Each distinct normalised name is resolved once, so a name repeated in a
    third of all rows is matched a single time. ``paged`` has ``(name, score)``.
    """
    normalize = tx.normalize_cpu_name if kind == "cpu" else tx.normalize_gpu_name
    default = CPU_DEFAULT if kind == "cpu" else GPU_DEFAULT
    rows = names.select(F.col(key), normalize(F.col(name)).alias("name"))
    distinct = rows.select("name").distinct()
    exact = scores.select("name", F.col("score").alias("exact"))
    looked = distinct.join(exact, "name", "left")
    open_names = looked.where(F.col("exact").isNull()).select("name")
    fuzzy = (
        best_match(open_names.select("name", F.col("name").alias("text")), "name", "text", scores)
        .where(F.col("match_score") > MIN_MATCH)
        .join(scores.select(F.col("name").alias("best_pattern"), F.col("score").alias("fuzzy")), "best_pattern")
        .select("name", "fuzzy")
    )
    looked = looked.join(fuzzy, "name", "left")
    if paged is not None:
        looked = looked.join(paged.select("name", F.nullif("score", F.lit(0)).alias("paged")), "name", "left")
    else:
        looked = looked.withColumn("paged", F.lit(None).cast("bigint"))
    resolved = looked.select(
        "name",
        F.coalesce("exact", "fuzzy", "paged", F.lit(default)).cast("bigint").alias("score"),
        F.when(F.col("exact").isNotNull(), "exact")
        .when(F.col("fuzzy").isNotNull(), "fuzzy")
        .when(F.col("paged").isNotNull(), "page")
        .otherwise("default")
        .alias("source"),
    )
    return rows.join(resolved, "name").select(key, "name", "score", "source")


def _rule_sql(text: str, rule: tuple[str, str, str], strip: bool) -> str:
    """SQL of the dictionary keys one rule proposes, in match order: model, then family."""
    pattern, family, model = rule
    head, *tail = model.split("{}")
    first = f"regexp_extract_all({text}, r'{pattern}', 1)"
    family_key = f"named_struct('name', '{family}', 'kind', 'family')"
    if len(tail) == 1:
        group = "trim(m)" if strip else "m"
        exact = f"named_struct('name', if(m <> '', concat('{head}', {group}), null), 'kind', 'exact')"
        return f"flatten(transform({first}, m -> array({exact}, {family_key})))"
    second = f"regexp_extract_all({text}, r'{pattern}', 2)"
    exact = f"named_struct('name', concat('{head}', a, '{tail[0]}', b), 'kind', 'exact')"
    return f"flatten(zip_with({first}, {second}, (a, b) -> array({exact}, {family_key})))"


def _all_candidates(text: str, rules: TextRules) -> Column:
    """Candidates of all rules as one SQL expression: building it call by call costs seconds."""
    listed = ", ".join(_rule_sql(text, rule, rules.strip) for rule in rules.rules)
    return F.expr(f"filter(concat({listed}), c -> c.name IS NOT NULL)")


def _keyword_family(text: str, keywords: Sequence[tuple[str, Sequence[str]]]) -> Column:
    arms = " ".join(f"WHEN contains({text}, '{word}') THEN '{family}'" for family, words in keywords for word in words)
    return F.expr(f"CASE {arms} END")


def score_from_text(df: DataFrame, key: str, text: str, scores: DataFrame, rules: TextRules) -> DataFrame:
    """``(key, score, matched_name, match_type, tried)`` for every row of ``df``.

    Order of resort: model or family of the first rule that has one in the
    score table, best dictionary match above the threshold, family of a keyword
    (or the default if the table lacks it), default. ``key`` must be unique.
    """
    rows = df.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("__text"))
    # Of a repeated name the last one counts.
    scores = scores.groupBy("name").agg(F.max_by(F.col("score").cast("bigint"), "ord").alias("score"), F.min("ord").alias("ord"))
    lookup = scores.select("name", "score")
    proposed = rows.select(
        key,
        F.array_distinct(_all_candidates("__text", rules)).alias("proposed"),
        _keyword_family("__text", rules.keywords).alias("keyword"),
    )
    last = F.array(F.struct(F.col("keyword").alias("name"), F.lit("keyword").alias("kind")))
    candidates = proposed.select(
        key,
        "keyword",
        F.size(F.filter("proposed", lambda c: c["kind"] == "exact")).alias("tried"),
        F.posexplode(F.concat("proposed", last)).alias("pos", "candidate"),
    )
    found = candidates.join(lookup, F.col("candidate.name") == F.col("name"), "left")
    by_rule = F.col("score").isNotNull() & (F.col("candidate.kind") != "keyword")
    hit = F.struct("score", "name", F.col("candidate.kind").alias("kind"))
    # Read twice below; written, so that the patterns run over the texts once.
    ruled = staged(
        found.groupBy(key).agg(
            F.min_by(F.when(by_rule, hit), F.when(by_rule, F.col("pos"))).alias("rule"),
            F.max(F.when(F.col("candidate.kind") == "keyword", F.col("score"))).alias("keyword_score"),
            F.max("keyword").alias("keyword"),
            F.max("tried").alias("tried"),
        ),
        "ruled",
    )
    unresolved = rows.join(ruled.where(F.col("rule").isNull()).select(key), key, "left_semi")
    fuzzy = (
        best_match(unresolved, key, "__text", scores)
        .where(F.col("match_score") > MIN_MATCH)
        .join(
            scores.select(F.col("name").alias("best_pattern"), F.col("score").alias("fuzzy_score")),
            "best_pattern",
        )
        .select(key, "best_pattern", "fuzzy_score")
    )
    default = F.lit(rules.default).cast("bigint")
    kind = (
        F.when(F.col("rule").isNotNull(), F.col("rule.kind"))
        .when(F.col("fuzzy_score").isNotNull(), "fuzzy")
        .when(F.col("keyword").isNotNull(), "keyword_fallback")
        .otherwise("default")
    )
    return ruled.join(fuzzy, key, "left").select(
        key,
        F.coalesce("rule.score", "fuzzy_score", "keyword_score", default).alias("score"),
        F.coalesce("rule.name", "best_pattern", "keyword", F.lit("unknown")).alias("matched_name"),
        kind.alias("match_type"),
        F.col("tried").cast("bigint").alias("tried"),
    )


def tried_models(df: DataFrame, key: str, text: str, rules: TextRules) -> DataFrame:
    """Model names each row proposes, one per line in order: the match trace."""
    rows = df.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("__text"))
    proposed = F.filter(_all_candidates("__text", rules), lambda c: c["kind"] == "exact")
    models = F.transform(proposed, lambda c: c["name"])
    return rows.select(key, F.posexplode(models).alias("pos", "model_name"))


def spec_columns(text: Column, strict: bool = False, trim: bool = False) -> dict[str, Column]:
    """Specs found in a searchable text, in output order."""
    return {
        "ram_gb": specs.ram_gb(text),
        "storage_gb": specs.storage_gb(text),
        "screen_size_inches": specs.screen_inches(text),
        "storage_type": specs.storage_type(text),
        "ram_type": specs.ram_type(text, strict),
        "processor_model": specs.cpu_model(text, trim),
        "gpu_model": specs.gpu_model(text, trim),
    }


def add_specs(df: DataFrame, texts: Sequence[str], strict: bool = False, trim: bool = False) -> DataFrame:
    """Specification columns and their categories from the given text columns."""
    present = [F.col(c).cast("string") for c in texts if c in df.columns]
    df = df.withColumn("__spec_text", tx.searchable(tx.combine_text(*present)))
    df = with_once(df, spec_columns(F.col("__spec_text"), strict, trim)).drop("__spec_text")
    return df.withColumns(
        {
            "storage_category": bins.storage_category(F.col("storage_gb")),
            "storage_display": bins.storage_display(F.col("storage_gb")),
            "ram_category": bins.ram_category(F.col("ram_gb")),
            "screen_category": bins.screen_category(F.col("screen_size_inches")),
        }
    )


def add_map_specs(df: DataFrame, details: str = "details_parsed") -> DataFrame:
    """Specification columns from a detail map."""
    entries = F.col(details)
    return df.withColumns(
        {
            "ram_gb": specs.spec_from_map(entries, "RAM", "GB"),
            "storage_gb": specs.storage_from_map(entries),
            "screen_size": specs.spec_from_map(entries, "Screen Size", "Inches"),
            "processor": specs.processor_from_map(entries),
        }
    )


def add_scores(
    df: DataFrame, key: str, texts: Sequence[str], cpu_scores: DataFrame, gpu_scores: DataFrame
) -> DataFrame:
    """Specs, CPU and GPU scores, total score, tier and gaming capability."""
    # A small file is one task, whose rows the patterns keep busy for long: the rows are dealt to all tasks once.
    df = staged(df.repartition(F.col(key)), "scored-rows")
    present = [F.col(c).cast("string") for c in texts if c in df.columns]
    rows = df.select(key, tx.searchable(tx.combine_text(*present)).alias("__all_text"))
    cpu = score_from_text(rows, key, "__all_text", cpu_scores, CPU).select(key, F.col("score").alias("cpu_benchmark_score"))
    gpu = score_from_text(rows, key, "__all_text", gpu_scores, GPU).select(key, F.col("score").alias("gpu_benchmark_score"))
    scored = add_specs(df, texts).join(cpu, key, "left").join(gpu, key, "left")
    total = bins.total_score(F.col("cpu_benchmark_score"), F.col("gpu_benchmark_score"))
    return scored.withColumn("total_benchmark_score", total).withColumns(
        {
            "performance_tier": bins.performance_tier(F.col("total_benchmark_score")),
            "gaming_capability": bins.gaming_capability(F.col("cpu_benchmark_score"), F.col("gpu_benchmark_score")),
        }
    )
