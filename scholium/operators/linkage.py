"""Entity and record linkage: exact, by trigrams, by embeddings; upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import written
from .ann import Index, search
from .blocks import nearest


def resolve_exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names (name, ...)`` with the entity of their trimmed lower-case form."""
    return names.withColumn("normalized_name", F.lower(F.trim("name"))).join(aliases, "normalized_name")


def new_names(names: DataFrame, known: DataFrame) -> DataFrame:
    return names.join(known.select("name").distinct(), "name", "left_anti")


def trigram_join(names: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b, jaccard)``, a < b, of distinct names whose trigram sets overlap enough.

    Sets are ordered by rarity, and only their prefixes meet in the join: two sets of Jaccard ``least`` share one of the
    first |s| - ceil(least |s|) + 1 grams, so that common grams hardly ever join.
    """
    sets = names.select("name", X.grams(F.lower("name")).alias("g")).where(F.size("g") > 0)
    each = sets.select("name", F.size("g").alias("n"), F.explode("g").alias("gram"))
    uses = each.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    ranked = each.join(uses, "gram").withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy("uses", "gram")))
    prefix = ranked.where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("name", "gram")
    pairs = prefix.alias("x").join(prefix.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    left, right = sets.select(F.col("name").alias("a"), F.col("g").alias("ga")), sets.select(F.col("name").alias("b"), F.col("g").alias("gb"))
    out = pairs.join(left, "a").join(right, "b").withColumn("jaccard", F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb")))
    return out.where(F.col("jaccard") >= least).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def resolve_by_embedding(new: DataFrame, old: DataFrame, threshold: float = 0.85, name_overlap: float = 0.6, k: int = 5, index: Index | None = None) -> DataFrame:
    """``(id, name, type, embedding)`` rows to ``(new_id, old_id, sim, band)``: the first of the k nearest that qualifies. With an ``index`` of
    ``old`` only its probed lists are looked at."""
    asked = new.select("id", "embedding")
    found = search(index, asked, k, 0.9 * threshold, among="all") if index else nearest(old.select("id", "embedding"), asked, k, 0.9 * threshold, among="all")
    near = found.select(F.col("qid").alias("new_id"), F.col("id").alias("old_id"), "sim", F.col("rank").alias("rn"))
    named = near.join(new.select(F.col("id").alias("new_id"), F.col("name").alias("na"), F.col("type").alias("ta")), "new_id").join(old.select(F.col("id").alias("old_id"), F.col("name").alias("nb"), F.col("type").alias("tb")), "old_id")
    typed = named.where((F.col("ta") == F.col("tb")) | (F.col("ta") == "concept"))
    high = (F.col("sim") >= threshold) & (X.gram_jaccard(F.lower("na"), F.lower("nb")) >= name_overlap)
    good = typed.withColumn("band", F.when(high, "high").when(F.col("sim") >= 0.95 * threshold, "gray")).where("band is not null")
    return good.withColumn("first", F.row_number().over(W.partitionBy("new_id").orderBy("rn"))).where("first = 1").select("new_id", "old_id", "sim", "band")


def in_order(new: DataFrame, old: DataFrame, threshold: float = 0.85, name_overlap: float = 0.6, k: int = 5) -> DataFrame:
    """Rows ``(ord, founded, found, band)`` for ``new (ord, name, type, embedding)``, as if its rows came one by one: each meets ``old (id, name, type,
    embedding)`` and what earlier rows founded, and takes the first of the k nearest that qualifies (``founded`` tells whether ``found`` is an
    ``ord`` or an ``id``; ``band`` as of ``resolve_by_embedding``); a row that takes none founds, and has a null ``found``.

    In rounds: a row is settled once nothing undecided lies before what it takes, that is, no earlier row that is still open is
    nearer to it; the first open row always is. Ties go to ``old`` before founders, then to the smaller id. Only nearest rows leave a task, never pairs.
    """
    floor = 0.9 * threshold
    rows = new.where("embedding is not null").select(F.col("ord").cast("long").alias("ord"), "name", "type", "embedding")
    open_, settled = written(rows, "open"), []
    vectors = lambda df: df.select(F.col("ord").alias("id"), "embedding")
    said = lambda df, i, flag: df.select(F.col(i).alias("cid"), F.lit(flag).alias("founded"), F.col("name").alias("nb"), F.col("type").alias("tb"))
    met = nearest(old.select("id", "embedding"), vectors(open_), k, floor, among="all").select(F.col("qid").alias("ord"), F.lit(False).alias("founded"), F.col("id").cast("long").alias("cid"), "sim")
    near = written(met.join(said(old.withColumn("id", F.col("id").cast("long")), "id", False), ["cid", "founded"]), "near")
    while not open_.isEmpty():
        waits = nearest(vectors(open_), vectors(open_), 1, floor, among="earlier").select(F.col("qid").alias("ord"), F.col("id").alias("wid"), F.col("sim").alias("wsim"))
        by = W.partitionBy("ord").orderBy(F.desc("sim"), "founded", "cid")
        ranked = near.join(open_.select("ord", F.col("name").alias("na"), F.col("type").alias("ta")), "ord").withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k)
        high = (F.col("sim") >= threshold) & (X.gram_jaccard(F.lower("na"), F.lower("nb")) >= name_overlap)
        band = F.when((F.col("ta") == F.col("tb")) | (F.col("ta") == "concept"), F.when(high, "high").when(F.col("sim") >= 0.95 * threshold, "gray"))
        place = F.struct(F.col("rn"), F.col("sim"), F.col("founded"), F.col("cid"), band.alias("band"))
        per = ranked.groupBy("ord").agg(F.min(F.when(band.isNotNull(), place)).alias("take"), F.max(place).alias("last"))
        both = open_.select("ord").join(per, "ord", "left").join(waits, "ord", "left")
        # Whether a candidate comes before the nearest open row in the order of similarity.
        ahead = lambda c: (F.col(f"{c}.sim") > F.col("wsim")) | ((F.col(f"{c}.sim") == F.col("wsim")) & (~F.col(f"{c}.founded") | (F.col(f"{c}.cid") < F.col("wid"))))
        free = F.col("wid").isNull()
        sure = F.when(F.col("take").isNotNull(), free | ahead("take")).otherwise(free | ((F.col("last.rn") == k) & ahead("last")))
        now = written(both.where(F.coalesce(sure, F.lit(False))).select("ord", "take.founded", F.col("take.cid").alias("found"), "take.band"), "settled")
        settled.append(now)
        founders = open_.join(now.where("found is null").select("ord"), "ord", "left_semi")
        open_ = written(open_.join(now.select("ord"), "ord", "left_anti"), "open")
        came = nearest(vectors(founders), vectors(open_), k, floor, among="earlier").select(F.col("qid").alias("ord"), F.lit(True).alias("founded"), F.col("id").alias("cid"), "sim")
        wide = near.join(open_.select("ord"), "ord", "left_semi").unionByName(came.join(said(founders, "ord", True), ["cid", "founded"]).select(*near.columns))
        near = written(wide.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).drop("rn"), "near")
    out = rows.select("ord", F.lit(None).cast("boolean").alias("founded"), F.lit(None).cast("long").alias("found"), F.lit(None).cast("string").alias("band")).limit(0)
    for part in settled:
        out = out.unionByName(part)
    return out


def resolved(new: DataFrame, old: DataFrame, threshold: float = 0.85, name_overlap: float = 0.6, entropy: float = 1.5, shortest: int = 6, few: int = 5, ambiguous: float = 0.5, within: bool = False) -> DataFrame:
    """Rows ``(ord, name, key, tier, reason, entity_id)`` for ``new (ord, name, type, embedding)`` against ``old (id, name, type, embedding)``.

    Exact names first; of other names equal ones go together, by their first row. Names of little entropy or length go to the third tier
    (the nearest of three entities above ``ambiguous``, unless there are fewer than ``few``); the rest to the second: an entity near by vector
    and name, or in the gray band by the names alone. What finds nothing founds an entity ``new:<key>``. With ``within`` the
    second tier meets what earlier rows of the batch founded too, and the third all that it founded; else that is met by exact name only.
    Null names are left out.
    """
    keyed = new.where("name is not null").withColumn("key", F.lower(F.trim("name")))
    aliases = old.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("id").alias("exact"))
    keys = written(keyed.groupBy("key").agg(F.min_by(F.struct("ord", "name", "type", "embedding"), "ord").alias("r")).join(aliases, "key", "left").select("key", "exact", "r.*"), "keys")
    open_ = keys.where("exact is null")
    vague = (X.name_entropy(F.col("name")) < entropy) | (F.length("name") < shortest)
    clear, unclear = open_.where(~vague), open_.where(vague)
    alike = X.gram_jaccard(F.lower("na"), F.lower("nb")) >= 0.5
    pool = old.select(F.col("id").cast("string").alias("entity"), "id", "name", "embedding")
    if within:
        took = written(in_order(clear, old, threshold, name_overlap), "took")
        # What a row takes may be an old entity, or the row that founded one.
        of_old = old.select(F.lit(False).alias("founded"), F.col("id").cast("long").alias("found"), F.col("name").alias("nb"), F.col("id").cast("string").alias("entity"))
        of_new = open_.select(F.lit(True).alias("founded"), F.col("ord").cast("long").alias("found"), F.col("name").alias("nb"), F.concat(F.lit("new:"), "key").alias("entity"))
        taken = took.join(of_old.unionByName(of_new), ["founded", "found"]).join(open_.select("ord", F.col("name").alias("na")), "ord")
        second = taken.where((F.col("band") == "high") | alike).select("ord", F.col("entity").alias("found"), F.when(F.col("band") == "high", "embedding").otherwise("gray").alias("reason"))
        # Ids of founders stand behind the old ones, in their order.
        top = old.agg(F.max(F.col("id").cast("long"))).first()[0] or 0
        none = clear.join(second.select("ord"), "ord", "left_anti").where("embedding is not null")
        pool = pool.withColumn("id", F.col("id").cast("long")).unionByName(none.select(F.concat(F.lit("new:"), "key").alias("entity"), (F.col("ord").cast("long") + 1 + top).alias("id"), "name", "embedding"))
    else:
        near = resolve_by_embedding(clear.select(F.col("ord").alias("id"), "name", "type", "embedding"), old, threshold, name_overlap)
        both = near.join(open_.select(F.col("ord").alias("new_id"), F.col("name").alias("na")), "new_id").join(old.select(F.col("id").alias("old_id"), F.col("name").alias("nb")), "old_id")
        second = both.where((F.col("band") == "high") | alike).select(F.col("new_id").alias("ord"), F.col("old_id").cast("string").alias("found"), F.when(F.col("band") == "high", "embedding").otherwise("gray").alias("reason"))
    asked = unclear.where("embedding is not null").select(F.col("ord").cast("long").alias("id"), "embedding")
    third = nearest(pool.select(F.col("id").cast("long").alias("id"), "embedding"), asked, 3, among="all").where((F.col("rank") == 1) & (F.col("sim") > ambiguous)).drop("rank")
    third = third.join(pool.select(F.col("id").cast("long").alias("id"), "entity"), "id").select(F.col("qid").alias("ord"), F.col("entity").alias("found"), F.lit("ambiguous").alias("reason"))
    if pool.limit(few).count() < few:
        third = third.limit(0)
    said = keys.withColumn("vague", vague).join(second.unionByName(third), "ord", "left")
    tier = F.when(F.col("exact").isNotNull(), 1).when(F.col("vague"), 3).otherwise(2)
    entity = F.coalesce(F.col("exact").cast("string"), F.col("found"), F.concat(F.lit("new:"), "key"))
    reason = F.when(F.col("exact").isNotNull(), "exact").otherwise(F.coalesce("reason", F.lit("new")))
    return keyed.select("ord", "name", "key").join(said.select("key", tier.alias("tier"), reason.alias("reason"), entity.alias("entity_id")), "key").select("ord", "name", "key", "tier", "reason", "entity_id")


def new_relations(relations: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows ``(source_id, target_id, relation_type)``: ``relations (source_name, target_name, relation_type)`` with both ends resolved by
    lower-case name (``names (key, id)``), no self loop, and not ``known (source_id, target_id, relation_type)`` yet."""
    of = lambda end: names.select(F.col("key").alias(f"{end}_key"), F.col("id").alias(f"{end}_id"))
    keyed = relations.withColumn("source_key", F.lower(F.trim("source_name"))).withColumn("target_key", F.lower(F.trim("target_name")))
    ends = keyed.join(of("source"), "source_key").join(of("target"), "target_key").where("source_id <> target_id")
    return ends.select("source_id", "target_id", "relation_type").distinct().join(known.distinct(), ["source_id", "target_id", "relation_type"], "left_anti")


def repeated_vectors(new: DataFrame, old: DataFrame, least: float = 0.95, index: Index | None = None) -> DataFrame:
    """The rows of ``new (id, embedding)`` that have a vector of ``old`` within ``least``; with an ``index`` of ``old``, one in its probed lists."""
    asked = new.select("id", "embedding")
    found = search(index, asked, 1, least) if index else nearest(old.select("id", "embedding"), asked, 1, least)
    return new.join(found.select(F.col("qid").alias("id")), "id", "left_semi")


def named_in(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", least: float = 0.5, shortest: int = 3) -> DataFrame:
    """Rows ``(id, name)``: lower-case ``names (name, confidence)`` that stand anywhere in the texts, words or parts of them.

    Each name meets the texts by its rarest trigram only; what meets is looked up in full.
    """
    known = names.where((F.length("name") >= shortest) & (F.col("confidence") >= least)).select(F.lower("name").alias("name")).distinct()
    name_grams = known.select("name", F.explode(X.grams(F.col("name"))).alias("gram"))
    low = texts.select(id_col, F.lower(text_col).alias("low"))
    text_grams = written(low.select(id_col, F.explode(X.grams(F.col("low"))).alias("gram")).join(name_grams.select("gram").distinct(), "gram", "left_semi"), "grams")
    uses = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    # A gram that no text has rules its name out.
    rarest = name_grams.join(uses, "gram", "left").fillna(0, ["uses"]).groupBy("name").agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram"))
    met = text_grams.join(rarest, "gram").join(low, id_col)
    return met.where(F.col("low").contains(F.col("name"))).select(id_col, "name").distinct()


def entities(docs: DataFrame, fewest: int, most: int, least_chars: int = 8) -> DataFrame:
    """Long tokens within a band of document frequencies, with mentions and confidence."""
    words = docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("name")).where(F.length("name") >= least_chars)
    found = words.groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("name").agg(F.sum("tf").alias("mentions"), F.count(F.lit(1)).alias("n_docs"))
    return found.where(F.col("n_docs").between(fewest, most)).withColumn("confidence", F.round(X.confidence(F.col("mentions"), F.col("n_docs"), F.lit("technique")), 3))


def merged(rows: DataFrame) -> DataFrame:
    """``(entity_id, ord, description, type, mentions, docs)`` to one row an entity: sums, unions, longest text, first type."""
    return rows.groupBy("entity_id").agg(
        F.sum("mentions").alias("mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"),
        F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"), F.min_by("type", "ord").alias("type"),
    )


def aliases(found: DataFrame, old: DataFrame) -> DataFrame:
    """Rows ``(normalized_name, entity_id)``: the names of ``old (id, name)``, and those that ``resolved`` led to an entity; a name of both is the old one's."""
    known = old.where("name is not null").groupBy(F.lower(F.trim("name")).alias("normalized_name")).agg(F.min("id").cast("string").alias("entity_id"))
    new = found.groupBy(F.col("key").alias("normalized_name")).agg(F.min("entity_id").alias("entity_id"))
    return known.unionByName(new.join(known.select("normalized_name"), "normalized_name", "left_anti"))


def merge_log(found: DataFrame, old: DataFrame) -> DataFrame:
    """Rows ``(ord, merged_from_name, merged_into, merged_into_name, reason)``: every row of ``resolved`` that joined an entity, old or founded by an
    earlier row of its name."""
    names = old.select(F.col("id").cast("string").alias("entity_id"), F.col("name").alias("into")).unionByName(
        found.where("reason = 'new'").groupBy("entity_id").agg(F.min_by("name", "ord").alias("into"))
    )
    first = found.where("reason = 'new'").groupBy("entity_id").agg(F.min("ord").alias("founder"))
    joined = found.join(first, "entity_id", "left").where("reason <> 'new' or ord > founder")
    reason = F.when(F.col("reason") == "new", "exact").otherwise(F.col("reason"))
    return joined.join(names, "entity_id").select("ord", F.col("name").alias("merged_from_name"), F.col("entity_id").alias("merged_into"), F.col("into").alias("merged_into_name"), reason.alias("reason"))


def upserted(rows: DataFrame, first_weight: float = 1.0) -> DataFrame:
    """Relations unique on (source, target, type): half a point for each repeat; self loops go. With ``ord``, ``description`` and ``doc_id``
    the first row's are kept."""
    grouped = rows.where("source_id <> target_id").groupBy("source_id", "target_id", "relation_type")
    first = [F.min_by(c, "ord").alias(c) for c in ("description", "doc_id") if {c, "ord"} <= set(rows.columns)]
    counted = grouped.agg(F.count(F.lit(1)).alias("seen"), *first)
    return counted.withColumn("weight", F.lit(first_weight) + 0.5 * (F.col("seen") - 1)).select("source_id", "target_id", "relation_type", "weight", "seen", *(c for c in ("description", "doc_id") if c in counted.columns))
