"""Contributions of features to a prediction, and the plain-language views of the strongest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators.concepts import resolve_concepts
from wardline.session import inline_table


def attribution_approx(
    long: DataFrame, importance: DataFrame, medians: DataFrame, direction: DataFrame | None = None
) -> DataFrame:
    """Adds `impact` = direction * importance * tanh(value - median); missing values count as 0.

    `long` is (record..., pos, feature, value). The other tables hold one row per matrix column, which
    bounds them by the width of the matrix. `direction` is (feature, direction) with +1 or -1; without
    it every feature points up.
    """
    out = long.join(importance.select("feature", "importance"), "feature", "left")
    out = out.join(medians.select("feature", "median"), "feature", "left")
    sign = F.lit(1.0)
    if direction is not None:
        out = out.join(direction.select("feature", "direction"), "feature", "left")
        sign = F.coalesce("direction", F.lit(1.0))
    away = fn.null_to_zero(F.col("value")) - fn.null_to_zero(F.col("median"))
    impact = sign * F.coalesce("importance", F.lit(0.0)) * F.tanh(away) + F.lit(0.0)  # no negative zero
    return out.select(*long.columns, impact.alias("impact"))


def directions(features: DataFrame, concepts: DataFrame) -> DataFrame:
    """(feature, direction): -1 where a lower value is the concerning one."""
    resolved = resolve_concepts(features.select("feature"), concepts)
    return resolved.select("feature", F.when(F.col("higher_is_concerning"), 1.0).otherwise(-1.0).alias("direction"))


def top_k(contributions: DataFrame, record: list[str], k: int) -> DataFrame:
    """The k largest by absolute impact per record, feature order on a tie.

    One record holds as many rows as the matrix has columns, so the window partitions are bounded.
    """
    order = Window.partitionBy(*record).orderBy(F.abs("impact").desc(), "pos")
    return contributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def contribution_array(
    features: list[str], weight: dict[str, float], median: dict[str, float], sign: dict[str, float]
) -> Column:
    """Approximate contributions of a wide row as an array in the order of `features`.

    The numbers per column fold into one constant; one lambda runs over it and the row's values, so
    the plan does not grow with the width of the matrix.
    """
    known = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f).alias("feature"),
                F.lit(float(sign.get(f, 1.0) * weight.get(f, 0.0))).alias("weight"),
                F.lit(float(median.get(f) or 0.0)).alias("median"),
            )
            for i, f in enumerate(features)
        ]
    )
    values = F.array(*[F.col("`" + f.replace("`", "``") + "`").cast("double") for f in features])

    def one(value, k):
        value = fn.null_to_zero(value)
        impact = k["weight"] * F.tanh(value - k["median"]) + F.lit(0.0)
        return F.struct(k["pos"].alias("pos"), k["feature"].alias("feature"), value.alias("value"), impact.alias("impact"))

    return F.zip_with(values, known, one)


def named_impacts(features: list[str], impacts: Column) -> Column:
    """The same entries from (pos, value, impact) that are worked out already; `features` names the positions."""
    names = F.array(*[F.lit(f) for f in features])
    return F.transform(impacts, lambda c: F.struct(
        c["pos"].alias("pos"), names[c["pos"]].alias("feature"), fn.null_to_zero(c["value"]).alias("value"), c["impact"].alias("impact"),
    ))


def top_k_array(contributions: Column, k: int) -> Column:
    """The same pick inside the row: strongest first, no shuffle."""
    ordered = F.array_sort(F.transform(contributions, lambda c: F.struct((-F.abs(c["impact"])).alias("o"), c["pos"].alias("p"), c.alias("c"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["c"])


def contributor_views(top: DataFrame, record: list[str], concepts: DataFrame, *, method: str = "approx") -> DataFrame:
    """Plain-language view per contribution: direction, magnitude relative to the record's strongest.

    Zero impacts point nowhere and give no view. `top` is the output of `top_k`.
    """
    strongest = F.max(F.abs("impact")).over(Window.partitionBy(*record))  # k rows per record
    scaled = top.withColumn("_max", F.coalesce(F.nullif(strongest, F.lit(0.0)), F.lit(1.0))).filter(F.col("impact") != 0)
    return resolve_concepts(scaled, concepts).select(
        *record,
        "rank",
        "feature",
        "concept",
        "phrase",
        F.when(F.col("impact") > 0, "increases").otherwise("decreases").alias("direction"),
        F.bround(F.abs("impact") / F.col("_max"), 3).alias("magnitude"),
        F.bround(fn.null_to_zero(F.col("value")), 3).alias("observed_value"),
        F.lit(method).alias("method"),
    )


def views_in_row(top: Column, words: dict[str, tuple[str, str]], *, method: str = "approx") -> tuple[Column, Column]:
    """(contributors, protective_factors) of a `top_k_array`, made inside the row: nothing is shuffled."""
    both = views_of_row(top, words, method=method)
    return both["contributors"], both["protective_factors"]


def views_of_row(top: Column, words: dict[str, tuple[str, str]], *, method: str = "approx") -> Column:
    """The two as one struct: taken apart in the same expression they would be worked out twice.

    `words` maps a feature to (concept, phrase), one entry per matrix column; it folds to a constant.
    """
    known = F.create_map(*[x for f, (name, phrase) in words.items() for x in (F.lit(f), F.array(F.lit(name), F.lit(phrase)))])

    def view(c, i, largest):
        word = known[c["feature"]]
        return F.struct(
            (i + 1).alias("rank"),
            word[0].alias("concept"),
            word[1].alias("phrase"),
            F.when(c["impact"] > 0, "increases").otherwise("decreases").alias("direction"),
            F.bround(F.abs(c["impact"]) / F.coalesce(F.nullif(largest, F.lit(0.0)), F.lit(1.0)), 3).alias("magnitude"),
            F.bround(fn.null_to_zero(c["value"]), 3).alias("observed_value"),
            c["feature"].alias("feature"),
            F.lit(method).alias("method"),
            c["impact"].alias("impact"),
        )

    # what stands in a lambda runs anew for each element: the pick and its largest impact are bound first
    every = _bound(top, lambda cells: _bound(
        F.array_max(F.transform(cells, lambda c: F.abs(c["impact"]))),
        lambda largest: F.transform(cells, lambda c, i: view(c, i, largest)),
    ))
    side = lambda views, keep: F.transform(F.filter(views, lambda x: keep(x["impact"])), lambda x: x.dropFields("impact"))
    return _bound(every, lambda views: F.struct(
        side(views, lambda x: x > 0).alias("contributors"), side(views, lambda x: x < 0).alias("protective_factors")
    ))


def _bound(value: Column, use) -> Column:
    """`use(value)`, where `value` is worked out once however often `use` mentions it: the variable of a lambda over an
    array of one."""
    return F.transform(F.array(value), use)[0]


def words_of(features: list[str], concepts: DataFrame) -> dict[str, tuple[str, str]]:
    """Concept and phrase per matrix column; one row per column comes to the driver."""
    table = inline_table(concepts.sparkSession, [(f,) for f in features], "feature string")
    return {r["feature"]: (r["concept"], r["phrase"]) for r in resolve_concepts(table, concepts).collect()}


def nest_views(views: DataFrame, record: list[str]) -> DataFrame:
    """Views per record as two arrays, strongest first: `contributors` (up), `protective_factors` (down)."""
    fields = ["rank", "concept", "phrase", "direction", "magnitude", "observed_value", "feature", "method"]
    pick = lambda way: F.array_sort(F.collect_list(F.when(F.col("direction") == way, F.struct(*fields))))
    # at most k views per record
    return views.groupBy(*record).agg(
        pick("increases").alias("contributors"), pick("decreases").alias("protective_factors")
    )
