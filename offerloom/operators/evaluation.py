"""Evaluation of search runs: case checks, stress reports, A/B gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.offer import field_issues, is_antibot
from offerloom.operators.ranking import top_n
from offerloom.sources.dims import sources_dim


def offer_issues(offers: DataFrame, keep: int = 5) -> DataFrame:
    """First ``keep`` field problems per case: case_id, issues, n_issues."""
    listed = offers.select(
        "case_id",
        "source",
        "position",
        F.posexplode(
            field_issues(
                F.col("source"), F.col("title"), F.col("price"), F.col("product_url"),
                F.col("image_url"),
            )
        ).alias("nth", "issue"),
    )
    counts = listed.groupBy("case_id").agg(F.count("*").alias("n_issues"))
    order = ["source", "position", "nth"]
    first = top_n(listed, ["case_id"], [F.asc(c) for c in order], keep)
    texts = first.groupBy("case_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, "issue"))), lambda x: x["issue"]
        ).alias("issues")
    )
    return texts.join(counts, "case_id")


def evaluate_cases(
    cases: DataFrame, groups: DataFrame, issues: DataFrame | None = None
) -> DataFrame:
    """Pass or fail of every case with its notes.

    ``cases``: case_id, took_ms, max_took_ms, min_sources_ok, min_total, allow_antibot,
    required (map source -> minimum). ``groups``: case_id, source, count, error (one row per
    source, so a case's groups are few). ``issues`` as from ``offer_issues`` for the cases
    whose fields are checked.
    """
    dim = sources_dim(groups.sparkSession).select("source", "ord")
    entry = F.struct("ord", "source", "count", "error")
    per_case = (
        groups.join(F.broadcast(dim), "source")
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("groups"))
    )
    joined = cases.join(per_case, "case_id", "left").withColumn(
        "groups", F.coalesce("groups", F.array())
    )
    if issues is not None:
        joined = joined.join(issues, "case_id", "left")
    else:
        joined = joined.withColumn("issues", F.lit(None).cast("array<string>"))
    excused = F.col("allow_antibot")

    def blocked(g: Column) -> Column:
        return excused & is_antibot(g["error"])

    sources_ok = F.size(F.filter("groups", lambda g: g["count"] > 0))
    total = F.aggregate("groups", F.lit(0).cast("bigint"), lambda acc, g: acc + g["count"])
    unexcused = F.size(F.filter("groups", lambda g: (g["count"] == 0) & ~blocked(g)))
    group_notes = F.filter(
        F.transform(
            "groups",
            lambda g: F.when(
                (g["count"] == 0) & (F.coalesce(g["error"], F.lit("")) != ""),
                F.when(
                    blocked(g),
                    F.concat(g["source"], F.lit(": antibot ("), F.substring(g["error"], 1, 60), F.lit(")")),
                ).otherwise(F.concat(g["source"], F.lit(": "), F.substring(g["error"], 1, 80))),
            ),
        ),
        lambda n: n.isNotNull(),
    )
    counted = joined.withColumns(
        {
            "sources_ok": sources_ok,
            "total": total,
            "_unexcused": unexcused,
            "_notes": group_notes,
        }
    )
    slow = F.col("took_ms") > F.col("max_took_ms")
    few = F.col("sources_ok") < F.col("min_sources_ok")
    enough = F.col("total") >= F.col("min_total")
    soft = few & enough & (F.col("_unexcused") == 0)

    def count_of(source: Column) -> Column:
        return F.coalesce(
            F.get(F.filter("groups", lambda g: g["source"] == source), 0)["count"],
            F.lit(0).cast("bigint"),
        )

    short = F.filter(
        F.transform(
            F.map_entries(F.coalesce("required", F.create_map().cast("map<string,int>"))),
            lambda e: F.when(
                count_of(e["key"]) < e["value"],
                F.concat(
                    e["key"], F.lit(": "), count_of(e["key"]).cast("string"), F.lit(" < "),
                    e["value"].cast("string"),
                ),
            ),
        ),
        lambda n: n.isNotNull(),
    )
    text = F.format_string
    plain = F.array(
        F.when(slow, text("timeout: %dms > %dms", "took_ms", "max_took_ms")),
        F.when(
            few,
            F.when(
                soft, text("soft pass: %d active sources, others antibot/unavailable", "sources_ok")
            ).otherwise(text("sources ok %d < %d", "sources_ok", "min_sources_ok")),
        ),
        F.when(~enough, text("products %d < %d", "total", "min_total")),
    )
    bad_fields = F.coalesce(F.size("issues"), F.lit(0)) > 0
    judged = counted.withColumn("_short", short)
    return judged.select(
        "case_id",
        (~slow & (~few | soft) & enough & (F.size("_short") == 0) & ~bad_fields).alias("passed"),
        "sources_ok",
        "total",
        F.concat(
            F.col("_notes"), F.filter(plain, lambda n: n.isNotNull()), F.col("_short"),
            F.coalesce("issues", F.array().cast("array<string>")),
        ).alias("notes"),
    )


def check_correction(queries: DataFrame, wanted: tuple[str, ...] = ("iphone", "айфон")) -> DataFrame:
    """Whether the corrected text names what was meant."""
    lowered = F.lower("corrected")
    found = F.lit(False)
    for word in wanted:
        found = found | lowered.contains(word)
    return queries.withColumn("correction_ok", found)


def stress_report(requests: DataFrame, variant: str = "variant") -> DataFrame:
    """Total, successes, success rate and elapsed seconds per variant."""
    total = F.count("*")
    return requests.groupBy(variant).agg(
        total.alias("total"),
        F.count_if("success").alias("successes"),
        (total - F.count_if("success")).alias("failures"),
        F.round(F.count_if("success") / total, 4).alias("success_rate"),
        F.round(
            (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1_000_000, 2
        ).alias("elapsed_sec"),
    )


def ab_gate(
    requests: DataFrame,
    with_ge: float = rules.GATE_WITH,
    without_lt: float = rules.GATE_WITHOUT,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Gate over variants ``with`` and ``without``: both rates and whether it passes."""
    rates = []
    for name in ("with", "without"):
        own = F.col("variant") == name
        rates.append(
            F.round(F.count_if(own & F.col("success")) / F.nullif(F.count_if(own), F.lit(0)), 4)
            .alias(f"rate_{name}")
        )
    return requests.groupBy(*keys).agg(*rates).withColumn(
        "pass",
        F.coalesce(
            (F.col("rate_with") >= with_ge) & (F.col("rate_without") < without_lt), F.lit(False)
        ),
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
