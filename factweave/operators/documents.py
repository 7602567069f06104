"""Facts lifted from documents: names, rules, patterns, vocabulary, mentions of things, and regions that a model has read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that one pass over the blocks looks for; a longer vocabulary takes several.
TERMS = 500
FACT = ("document", "position", "subject", "predicate", "object_text")


@dataclass(frozen=True)
class Lift:
    """Every match of a pattern (its group 1, if ``group``) as an object of the document or of the block's rule."""

    predicate: str
    pattern: str
    group: int = 0
    ref: str | None = None
    on_rule: bool = False


def names(blocks: DataFrame) -> DataFrame:
    """The first block of each of ``blocks(document, position, block)`` is its name."""
    return blocks.where("position = 0").select("document", "position", F.col("document").alias("subject"), F.lit("name").alias("predicate"), F.trim("block").alias("object_text"))


def rule_of(pattern: str, text: int = 2) -> tuple[Column, Column]:
    """The rule that a block states, by the pattern's group 1, and its text; both null if it states none."""
    block = F.trim("block")
    whole = f"(?s)^(?:{pattern})"
    said = F.col("block").isNotNull() & block.rlike(whole)
    rule = F.concat(F.lit("rule:"), F.regexp_replace("document", "^[^:]*:", ""), F.lit("-"), F.lower(F.regexp_extract(block, whole, 1)))
    return F.when(said, rule), F.when(said, F.trim(F.regexp_extract(block, whole, text)))


def lifted(blocks: DataFrame, rule: str, lifts: Sequence[Lift]) -> DataFrame:
    """Rules and lifted values of every block, in one pass over the text."""
    holder, said = rule_of(rule)
    item = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object_text"))

    def matches(lift: Lift) -> Column:
        who = F.coalesce(holder, F.col("document")) if lift.on_rule else F.col("document")
        value = lambda x: F.concat(F.lit(f"{lift.ref}:"), x) if lift.ref else x
        return F.transform(F.regexp_extract_all("block", F.lit(lift.pattern), F.lit(lift.group)), lambda x: item(who, lift.predicate, value(x)))

    found = [F.array(item(holder, "rule_text", said)), *map(matches, lifts)]
    rows = blocks.where("block IS NOT NULL").select("document", "position", F.inline(F.concat(*found)))
    return rows.where("subject IS NOT NULL AND object_text IS NOT NULL").select(*FACT)


def terms_in(blocks: DataFrame, vocabulary: DataFrame, predicate: str, ref: str | None = None) -> DataFrame:
    """Terms of ``vocabulary(term)`` that a block contains, in any case, with a dash or a blank.

    About ``TERMS`` terms go into one pass as literals, chosen by their hash, so that a vocabulary of any length is looked for whole.
    """
    terms = vocabulary.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    parts = -(-terms.count() // TERMS)
    out = None
    for part in range(max(parts, 1)):
        held = [r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))) == part).collect()]
        text = F.lower("block")
        fits = F.filter(F.array(*map(F.lit, sorted(held))).cast("array<string>"), lambda t: F.contains(text, F.lower(t)) | F.contains(text, F.lower(F.replace(t, F.lit("-"), F.lit(" ")))))
        value = F.concat(F.lit(f"{ref}:"), F.col("x")) if ref else F.col("x")
        rows = blocks.select("document", "position", F.explode(fits).alias("x")).select("document", "position", F.col("document").alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object_text"))
        out = rows if out is None else out.unionByName(rows)
    return out


WORD = r"(?U)\w+"
#: Words of a name that texts are looked up by, hashes that are told apart beforehand, and tasks that rows of one key are dealt to.
GRAM, FLAGS, DEAL = 2, 1 << 20, 32


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(document, name)`` where the text in lower case has a name of ``names(name)``, each given once, as whole words.

    A name's first words (``GRAM`` at most) are neighbours in every text that has it; one without a word begins with three other characters.
    Both sides meet by hashes of those, which leave a text only if they are in a table of ``FLAGS`` hashes of the names, and the texts are searched for what has met.
    """
    said = texts.select("document", F.lower("text").alias("text")).where("text IS NOT NULL")
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    first = F.slice(words("name"), 1, GRAM)
    key = F.when(F.size(first) > 0, F.xxhash64(F.concat_ws(" ", first))).otherwise(F.xxhash64(F.substring("name", 1, 3)))
    asked = names.select("name", key.alias("key"))
    flags = F.broadcast(asked.select(F.pmod("key", F.lit(FLAGS)).alias("flag")).distinct())

    def grams(w: Column) -> Column:
        at = lambda n: F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)])))
        return F.concat(*map(at, range(1, GRAM + 1)), F.transform(F.regexp_extract_all("text", F.lit(r"(?U)(?=(\W{3}))"), F.lit(1)), lambda x: F.xxhash64(x)))

    told = said.select("document", "text", words("text").alias("words")).select("document", F.explode(F.array_distinct(grams(F.col("words")))).alias("key"))
    met = told.withColumn("flag", F.pmod("key", F.lit(FLAGS))).join(flags, "flag", "left_semi").drop("flag")
    held = dealt(met, asked, "key").groupBy("document").agg(F.collect_set("name").alias("names"))
    # \E inside a name would end the quotation.
    quoted = lambda x: F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?!\\w)"))
    found = F.filter("names", lambda x: F.contains(F.col("text"), x) & F.regexp_like(F.col("text"), quoted(x)))
    return said.join(held, "document").select("document", F.explode(found).alias("name"))


def dealt(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An equi-join whose rows of one key on the left are dealt out to ``DEAL`` tasks, each with the right's rows of that key."""
    a = left.withColumn("__deal", F.pmod(F.xxhash64(*left.columns), F.lit(DEAL)))
    return a.join(right.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long")))), [key, "__deal"]).drop("__deal")


def mentions(texts: DataFrame, named: DataFrame, least: int = 3) -> DataFrame:
    """``(document, entity)`` where the text has a name of the entity as whole words, in any case; names under ``least`` characters don't count.

    Entities with the same names are one class; only classes are made distinct, and their members come last, without another exchange of pairs.
    """
    classes, kinds = entity_classes(named, least)
    return dealt(mentioned(texts, kinds), classes, "class").select("document", "entity")


def entity_classes(named: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(entity, class)`` and ``(class, name)``: entities of equal sets of names in lower case are one class, named after the smallest."""
    sets = named.select("entity", F.lower("name").alias("name")).where(F.length("name") >= least).groupBy("entity").agg(F.array_sort(F.collect_set("name")).alias("names"))
    kinds = sets.groupBy("names").agg(F.min("entity").alias("class"))
    return sets.join(kinds, "names").select("entity", "class"), kinds.select("class", F.explode("names").alias("name"))


def mentioned(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(document, class)``, each once, of the classes of which a text has a name."""
    return dealt(named_in(texts, kinds.select("name").distinct()), kinds, "name").select("document", "class").distinct()


def applies_to(texts: DataFrame, covers: DataFrame, named: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """Documents that speak of an entity: they mention it, or cover ``(document, zone)`` the zone that it is in ``(entity, zone)``.

    Each pair comes once without comparing pairs: by the smallest zone that both have, or, if they have none in common, by the entity's class.
    """
    zones = lambda rows, who: rows.where("zone IS NOT NULL").groupBy(who).agg(F.array_sort(F.collect_set("zone")).alias(f"{who}_zones"))
    of_text, of_entity = zones(covers, "document"), zones(places, "entity")
    shared = F.array_intersect("document_zones", "entity_zones")
    here = dealt(of_text.withColumn("zone", F.explode("document_zones")), of_entity.withColumn("zone", F.explode("entity_zones")), "zone")
    covered = here.where(F.col("zone") == F.array_min(shared)).select("document", "entity")
    classes, kinds = entity_classes(named, least)
    said = dealt(mentioned(texts, kinds).join(of_text, "document", "left"), classes.join(of_entity, "entity", "left"), "class")
    alone = F.coalesce(F.size(shared) == 0, F.lit(True)) | F.col("document_zones").isNull() | F.col("entity_zones").isNull()
    return covered.unionByName(said.where(alone).select("document", "entity"))


def tagged(rows: DataFrame, tag: str, register: DataFrame, default: str = "machine") -> DataFrame:
    """``rows`` with ``ref``: the tag in lower case, typed by the first ``register(row, name, type)`` whose name has it as a word."""
    words = register.select("row", "type", F.explode(F.array_distinct(F.split(F.trim("name"), r"\s+"))).alias(tag)).groupBy(tag).agg(F.min_by("type", "row").alias("__type"))
    kind = F.coalesce("__type", F.lit(default))
    return rows.join(words, tag, "left").withColumn("ref", F.concat_ws(":", kind, F.lower(tag))).drop("__type")


EXTRACTION = "model string, prompt_sha256 string, image string, taken string, regions array<struct<text:string,box:array<string>>>"


def extractions(rows: DataFrame, column: str, register: DataFrame) -> DataFrame:
    """Notes that a model has read in regions of an image: inferred facts on the tag before the colon, or on the image's document."""
    read = rows.select(F.from_json(column, EXTRACTION).alias("x")).select("x.*").select(
        "taken", "image", F.concat_ws("@", "model", F.substring("prompt_sha256", 1, 12)).alias("model"), F.posexplode("regions").alias("region", "r")
    )
    has = F.contains(F.col("r.text"), F.lit(":"))
    notes = read.where("r.text IS NOT NULL").select(
        "image", "region", "taken", "model", F.col("r.text").alias("object_text"), F.concat(F.lit("region "), F.array_join("r.box", ",")).alias("locator"),
        F.when(has, F.trim(F.substring_index("r.text", ":", 1))).alias("tag"),
    )
    stem = F.regexp_replace(F.regexp_replace("image", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    on = F.when(F.col("tag").isNull(), F.concat(F.lit("document:"), stem)).otherwise(F.col("ref"))
    return tagged(notes, "tag", register).select("image", "region", on.alias("subject"), "object_text", "taken", F.lit("inferred").alias("kind"), "locator", "model")
