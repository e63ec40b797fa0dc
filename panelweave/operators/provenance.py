"""How each gene got into, or out of, a panel -- folded from an event table.

``events(stage, iteration, action, gene, replaces, source)``: stage is one of
STAGES, action 'add' or 'remove'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import pin

# Stages in order, and the texts written to the report.
STAGES = ["initial", "blacklist", "force", "xenium", "odt"]
REASONS = {"blacklist": "blacklist_filter", "force": "replaced_by_force_include",
           "xenium": "xenium_expression_filter", "odt": "odt_designability_filter"}
SOURCES = {"initial": "initial_selection", "blacklist": "blacklist_replacement", "force": "force_include",
           "xenium": "xenium_replacement", "odt": "odt_replacement"}


def _pick(col, mapping):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def provenance(events: DataFrame, strategy: str) -> DataFrame:
    """One row per gene with its source, the outcome of every filter and its final status."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("int") - 1
    e = events.withColumn("_o", order * 1000 + F.coalesce("iteration", F.lit(0)))
    add, rem = F.col("action") == "add", F.col("action") == "remove"
    born = F.min(F.when(add, F.struct("_o", "stage", "replaces", "source", "iteration", "rank"))).alias("born")
    died = F.max(F.when(rem, F.struct("_o", "stage"))).alias("died")
    forced = F.bool_or(add & (F.col("stage") == "force")).alias("forced")
    gone = F.max(F.when(rem & (F.col("stage") == "blacklist"), 1)).alias("bl_failed")
    first_death = F.min(F.when(rem, F.col("_o"))).alias("first_death")
    g = e.groupBy("gene").agg(born, died, forced, gone, first_death).filter(F.col("born").isNotNull())
    ran = events.agg(F.struct(*[F.bool_or(F.col("stage") == s).alias(s) for s in ("xenium", "odt")]).alias("r"))
    g = g.withColumn("_ran", ran.scalar())
    stage, dead = F.col("born.stage"), F.col("died.stage")

    def tested(s: str):
        at = STAGES.index(s) * 1000
        alive = (F.col("born._o") < at) & (F.col("first_death").isNull() | (F.col("first_death") >= at))
        return F.when(dead == s, "failed").when(stage == s, "passed").when(alive & F.col(f"_ran.{s}"), "passed").otherwise("not_tested")

    blacklist = (
        F.when(F.col("bl_failed") == 1, "failed").when(stage == "force", "exempt")
        .when(stage.isin("xenium", "odt"), "not_tested").otherwise("passed")
    )
    details = (
        F.when(stage == "initial", F.coalesce("born.source", F.lit(strategy)))
        .when(stage == "blacklist", F.coalesce("born.source", F.lit("unknown")))
        .when(stage == "force", "user_specified").when(stage == "xenium", "expression_filtered").otherwise("designability_filtered")
    )
    return g.select(
        "gene", F.col("born.rank").alias("selection_rank"),
        F.when(F.col("forced"), SOURCES["force"]).otherwise(_pick(stage, SOURCES)).alias("initial_source"),
        details.alias("source_details"), blacklist.alias("blacklist_status"),
        F.when(stage == "blacklist", F.col("born.replaces")).alias("blacklist_replacement_for"),
        tested("xenium").alias("xenium_status"), F.when(stage == "xenium", F.col("born.replaces")).alias("xenium_replacement_for"),
        tested("odt").alias("odt_status"), F.when(stage == "odt", F.col("born.replaces")).alias("odt_replacement_for"),
        F.when(F.col("died").isNull(), "selected").otherwise("removed").alias("final_status"),
        _pick(dead, REASONS).alias("removal_reason"),
        F.when(stage.isin("xenium", "odt"), F.col("born.iteration")).cast("int").alias("replacement_iteration"),
    )


def inherit_celltype(prov: DataFrame, celltypes: DataFrame) -> DataFrame:
    """Add celltype; a replacement takes the type of the nearest gene with one along its chain of replaced genes.

    Every round a gene without type looks at the gene it points to, takes that one's type or else points where that one
    points, so a chain of n links takes log2(n) rounds.  Rings without a type keep null.
    """
    prov = pin(prov)
    link = F.coalesce("blacklist_replacement_for", "xenium_replacement_for", "odt_replacement_for").alias("_for")
    p = pin(prov.select("gene", link).join(celltypes.select("gene", "celltype"), "gene", "left"))
    reach, n = 1, p.count()
    while reach <= n and p.filter("celltype is null and _for is not null").limit(1).count():
        up = p.select(F.col("gene").alias("_g"), F.col("celltype").alias("_ct"), F.col("_for").alias("_next"))
        p = pin(p.join(up, F.col("_for") == F.col("_g"), "left").select(
            "gene", F.coalesce("celltype", "_ct").alias("celltype"), F.when(F.coalesce("celltype", "_ct").isNull(), F.col("_next")).alias("_for")))
        reach *= 2
    return prov.join(p.select("gene", "celltype"), "gene", "left")


def final_panel(prov: DataFrame) -> DataFrame:
    return prov.filter(F.col("final_status") == "selected")


def provenance_summary(prov: DataFrame) -> DataFrame:
    """One row of counts."""
    src, c = F.col("initial_source"), F.count_if
    return prov.agg(
        c(src == "initial_selection").alias("initial_genes"), c(F.col("final_status") == "selected").alias("final_genes"),
        c(F.col("blacklist_status") == "failed").alias("blacklist_removed"), c(src == "blacklist_replacement").alias("blacklist_replacements"),
        c(F.col("xenium_status") == "failed").alias("xenium_removed"), c(src == "xenium_replacement").alias("xenium_replacements"),
        c(F.col("odt_status") == "failed").alias("odt_removed"), c(src == "odt_replacement").alias("odt_replacements"),
        c(src == "force_include").alias("force_included"), c(F.col("removal_reason") == "replaced_by_force_include").alias("removed_by_force_include"),
    )


# Source texts, category names and the order they are tried in; the order decides the result.

def source_categories(prov: DataFrame, reduction: str = "NMF") -> DataFrame:
    """Genes per source category, in report order; blacklisted rows are left out."""
    src, det = F.col("initial_source"), F.coalesce("source_details", F.lit(""))
    low = F.lower(det)
    cell = low.contains("cell-type") | low.contains("celltype")
    gap = (F.when(cell, "cell-type-specific gap-filling").when(low.contains("global"), "global gap-filling")
           .when(low.contains("deg"), "DEG-based gap-filling").otherwise("gap-filling"))
    initial = (
        F.when(low == "dt", "DT").when(low.isin("nmf", "pca"), F.upper(det))
        .when(low.contains("both"), f"both (DT & {reduction})").when(low.contains("dimred"), reduction)
        .when(low.contains("gap-filling") | low.contains("cell-type"), gap)
        .when(det != "", det).otherwise("initial_selection")
    )

    def repl(col, tag):
        return F.concat(F.lit("replacement for "), F.coalesce(col, F.lit("unknown")), F.lit(f" ({tag})"))

    source = (
        F.when(src == "force_include", "user-defined-marker")
        .when(src == "blacklist_replacement", repl("blacklist_replacement_for", "blacklist"))
        .when(src == "xenium_replacement", repl("xenium_replacement_for", "xenium"))
        .when(src == "odt_replacement", repl("odt_replacement_for", "odt"))
        .when(src == "initial_selection", initial).otherwise(src)
    )
    p = prov.withColumn("gene_source", source).filter(~F.lower("gene_source").contains("blacklisted"))
    s = F.lower("gene_source")
    isgap, isrep = s.contains("gap-filling") | s.contains("gap-fill"), s.contains("replacement for")
    rules = [
        ("User-defined Markers", s.contains("user-defined") | s.contains("user-specified")),
        ("Blacklist Replacement", isrep & s.contains("blacklist")), ("Xenium Replacement", isrep & s.contains("xenium")),
        ("ODT Replacement", isrep & s.contains("odt")), ("Other Replacement", isrep),
        ("Gap-filling: Cell-type", isgap & s.contains("cell-type")), ("Gap-filling: Global", isgap & s.contains("global")),
        ("Gap-filling: DEG", isgap & s.contains("deg")), ("Gap-filling: Other", isgap),
        (f"Both (DT & {reduction})", s.contains("both")), ("DT-unique", s == "dt"), (f"{reduction}-unique", s.isin("nmf", "pca")),
    ]
    cat = F.lit("Other")
    for name, cond in reversed(rules):
        cat = F.when(cond, name).otherwise(cat)
    # Order of the categories in reports.
    report = ["User-defined Markers", "DT-unique", f"{reduction}-unique", f"Both (DT & {reduction})", "Gap-filling: Cell-type",
              "Gap-filling: Global", "Gap-filling: DEG", "Gap-filling: Other", "Blacklist Replacement", "Xenium Replacement",
              "ODT Replacement", "Other Replacement", "Other"]
    place = F.array_position(F.array(*[F.lit(c) for c in report]), F.col("category")).cast("int")
    return p.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n_genes")).withColumn("position", place).orderBy("position")
