"""Panel names: building them from paths and reading their attributes back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that appear in panel names.
FILLINGS = ["cell-type-specific-filling", "global-gene-filling", "DEG-based-filling"]
SIMPLE_STRATEGIES = ["deg_only", "dt_simple", "dt_deg", "rf_simple", "rf_deg", "hvg", "random"]
EXTERNAL = ["Spapros", "mMulti_v1", "5k"]
DIMRED_PATTERN = r"((?:pca|nmf)_(?:global|per_celltype)_method_[ab])"
COMBINED_PATTERN = r"((?:dt|rf)_(?:pca|nmf)_(?:DT|RF)[0-9.]+_Dimred[0-9.]+_(?:global|per_celltype)_method_[ab])"


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def panel_name_from_path(path: Column) -> Column:
    """``filter_subset_strategy[_Nfactors]_size[_filling]`` from a result path, else the file stem."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "results").cast("int")

    def back(n: int) -> Column:
        return F.get(parts, at - 1 - n)

    base = F.element_at(parts, -1)
    has_factors = back(2).endswith("_factors")
    n_factors = F.regexp_replace(back(2), "_factors", "")
    numbered = F.regexp_extract(base, r"selected_(?:hvg|random)_(\d+)genes\.csv", 1)
    is_numbered = base.startswith("selected_hvg_") | base.startswith("selected_random_")
    size = F.when(is_numbered & (numbered != ""), numbered).otherwise(F.regexp_replace(back(1), "-genes", ""))
    filling = F.when(~is_numbered & (base != "selected_genes.csv"),
                     F.regexp_replace(F.regexp_replace(base, "selected_genes_", ""), r"\.csv", ""))
    filling = F.when(filling != "", filling)
    with_f = F.concat_ws("_", back(5), back(4), back(3), F.concat(n_factors, F.lit("factors")), size, filling)
    without = F.concat_ws("_", back(4), back(3), back(2), size, filling)
    usable = (at > 0) & F.when(has_factors, at > 5).otherwise(at > 4)
    return F.when(usable, F.when(has_factors, with_f).otherwise(without)).otherwise(file_stem(path))


def _clean(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.h5ad$", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once.

    Plain nesting would copy the value's whole expression to every place it is
    used when Spark merges projections and filters.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The tokens of panel names and the order they are tried in, from here to ``attributes``; the order decides the result.

def _strategy(core: Column) -> Column:
    tok = F.split(core, "_")
    s = (
        F.when(F.array_contains(tok, "Spapros") & ~core.endswith("Spapros-addon"), "Spapros")
        .when((F.array_contains(tok, "mMulti") | core.contains("mMulti_v1")) & ~core.endswith("mMulti-addon"), "mMulti_v1")
        .when(F.array_contains(tok, "5k") & ~core.contains("5k-addon"), "5k")
    )
    for name in SIMPLE_STRATEGIES:
        s = s.when(core.contains(f"_{name}_") | core.endswith(f"_{name}"), name)
    for name in ("Random", "HVG"):
        s = s.when(F.array_position(tok, name) > 2, name)
    for p in (DIMRED_PATTERN, COMBINED_PATTERN):
        s = s.when(F.regexp_like(core, F.lit(p)), F.regexp_extract(core, p, 1))
    return s.otherwise(core)


def _core(full: Column) -> Column:
    c = F.regexp_replace(full, r"_(\d+)factors_", "_")
    f = _filling(full)
    return F.when(f.isNotNull(), F.replace(c, F.concat(F.lit("_"), f), F.lit(""))).otherwise(c)


def _filling(full: Column) -> Column:
    return F.coalesce(*[F.when(full.contains(f), F.lit(f)) for f in FILLINGS])


def _attributes(full: Column, strategy: Column) -> Column:
    parts = F.split(full, "_")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    addon = F.get(F.filter(parts, lambda p: p.contains("addon") & (
        p.contains("5k-addon") | p.contains("mMulti-addon") | ~p.contains("no-addon"))), F.lit(0))
    nf = F.regexp_extract(full, r"_(\d+)factors_", 1)
    return F.struct(
        strategy.alias("strategy"), _filling(full).alias("filling_method"), F.when(nf != "", nf.cast("int")).alias("n_factors"),
        F.when(~(strategy.isin(EXTERNAL) & first.isin("5k", "mMulti", "mMulti_v1")), first).alias("filter"),
        F.when(second.contains("All-Genes") | second.contains("HVG"), second).when(second.isNotNull(), "All-Genes").alias("baseline"),
        F.when(addon.contains("5k-addon"), "5k-addon").when(addon.contains("mMulti-addon"), "mMulti-addon")
        .when(addon.isNotNull(), "addon").when(strategy == "5k", "5k-reference")
        .when(strategy == "mMulti_v1", "mMulti-reference").otherwise("no-addon").alias("addon_type"),
        F.get(F.filter(parts, lambda p: p.rlike(r"^[0-9]+$")), F.lit(0)).alias("panel_size"),
    )


def attributes(name: Column) -> Column:
    """Struct of filter, baseline, strategy, panel_size, addon_type, filling_method and n_factors."""
    return bound(_clean(name), lambda full: bound(bound(_core(full), _strategy), lambda s: _attributes(full, s)))


def parse_panel_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Add the attributes of a panel name as columns."""
    return df.withColumn("_a", attributes(F.col(name))).select(*df.columns, "_a.*")


def group_panels(df: DataFrame, name: str = "name") -> DataFrame:
    """Group key per name; external 5k / mMulti panels join every matching add-on group."""
    p = df.select(name, attributes(F.col(name)).alias("_a"))
    kind = bound(F.col("_a"), lambda a: F.when(a["strategy"] == "5k", "5k-addon").when(a["strategy"] == "mMulti_v1", "mMulti-addon"))
    key = bound(F.col("_a"), lambda a: F.concat_ws(
        "_", F.coalesce(a["filter"], F.lit("unknown-filter")), F.coalesce(a["baseline"], F.lit("unknown-baseline")),
        F.coalesce(a["panel_size"], F.lit("unknown-size")), a["addon_type"]))
    p = p.select(name, kind.alias("_kind"), key.alias("group_key"))
    own = p.filter(F.col("_kind").isNull()).select(name, "group_key")
    ext = p.filter(F.col("_kind").isNotNull()).select(name, "_kind")
    keys = own.select("group_key").distinct().withColumn(
        "_kind", F.when(F.col("group_key").contains("5k-addon"), "5k-addon").when(F.col("group_key").contains("mMulti-addon"), "mMulti-addon")
    )
    return own.unionByName(keys.join(ext, "_kind").select(name, "group_key"))


def filter_by_keywords(df: DataFrame, keywords: Sequence[str], name: str = "name") -> DataFrame:
    """Keep names whose strategy contains a keyword or is contained in one (case-insensitive)."""
    def hit(a: Column) -> Column:
        s = F.lower(a["strategy"])
        return _any(s.contains(k.lower()) | F.contains(F.lit(k.lower()), s) for k in keywords)

    return df.filter(bound(attributes(F.col(name)), hit))


def _any(terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def filter_panels(
    df: DataFrame, name: str = "name", strategies: Sequence[str] = (), sizes: Sequence[int] = (),
    filter_methods: Sequence[str] = (), hvg_subset: Sequence[str] = (), reduction_types: Sequence[str] = (),
    analysis_types: Sequence[str] = (), dimred_methods: Sequence[str] = (), rf_percentages: Sequence[float] = (),
    dimred_percentages: Sequence[float] = (), celltype_filling: bool | None = None, global_filling: bool | None = None,
    deg_filling: bool | None = None, preferred_strategy: str | None = None,
) -> DataFrame:
    """All given criteria must hold; an empty criterion is off."""
    def keep_row(a: Column) -> Column:
        low = F.lower(a["strategy"])
        flat = F.replace(low, F.lit("_"), F.lit(""))
        keep = F.lit(True)
        if strategies:
            keep = keep & _any(low.contains(s.lower()) for s in strategies)
        if sizes:
            keep = keep & (a["panel_size"].isNull() | a["panel_size"].cast("long").isin(list(sizes)))
        if filter_methods:
            word = {"scanpy": "Scanpy", "10x": "Xenium", "no_filter": "No-Filter"}
            keep = keep & F.coalesce(_any(a["filter"].contains(word[m]) for m in filter_methods), F.lit(False))
        if hvg_subset:
            word = {"true": "HVG", "false": "All-Genes"}
            keep = keep & F.coalesce(_any(a["baseline"].contains(word[o]) for o in hvg_subset), F.lit(False))
        if reduction_types:
            keep = keep & _any(low.contains(r) for r in reduction_types)
        if analysis_types:
            keep = keep & _any(low.contains(a) for a in analysis_types)
        if dimred_methods:
            keep = keep & _any(flat.contains(m.replace("_", "")) for m in dimred_methods)
        if rf_percentages:
            keep = keep & F.coalesce(F.regexp_extract(a["strategy"], r"(?:DT|RF)([0-9.]+)", 1).try_cast("double").isin(list(rf_percentages)), F.lit(False))
        if dimred_percentages:
            keep = keep & F.coalesce(F.regexp_extract(a["strategy"], r"Dimred([0-9.]+)", 1).try_cast("double").isin(list(dimred_percentages)), F.lit(False))
        for wanted, label in zip((celltype_filling, global_filling, deg_filling), FILLINGS):
            if wanted is not None:
                keep = keep & (a["filling_method"].eqNullSafe(F.lit(label)) == F.lit(wanted))
        if preferred_strategy:
            keep = keep & (a["filling_method"].isNull() | F.lower(a["filling_method"]).contains(preferred_strategy.lower()))
        return keep

    return df.filter(bound(attributes(F.col(name)), keep_row))


def find_panels_like(df: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Distinct names holding the pattern as given, dashed, capitalised, upper or lower case."""
    variants = {pattern, pattern.replace("_", "-"), pattern.capitalize(), pattern.upper(), pattern.lower()}
    return df.filter(_any(F.col(name).contains(v) for v in sorted(variants))).select(name).distinct()
