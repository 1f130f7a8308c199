"""A table of search queries against the registry, as equi-joins.

Comparing every query with every item is what this avoids. Each item is turned into the keys a query can ask
for: the combinations of its tag, domain and status that occur among the queries, and the searched-for
keywords that occur in it. A query is joined on all it asks for at once, so nothing is left to test.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from taskfold.operators.search import TEXT_FIELDS, keyword_predicate
from taskfold.schema import KEY, STORED_ORDER
from taskfold.session import stored

#: Lengths of grams, longest first. A word goes by one of the longest that fit into it; a short one by its first character.
_GRAMS = (12, 6, 3, 1)
_SMALL = ["_domain", "_status", "_tags", *STORED_ORDER]


def search_many(features: DataFrame, queries: DataFrame, kept_words: int | None = None) -> DataFrame:
    """(query_id, project_id, id, ord_batch, ord_pos) of every match. A null filter is absent.

    ``kept_words``: see :func:`hits_by_gram`; it changes the plan and not the result.
    """
    asked = _normalised(queries).withColumn("mask", _mask()).withColumn("key", _query_key())
    masks = [r["mask"] for r in asked.select("mask").distinct().collect()]  # at most eight
    with_word = asked.filter("q_word is not null").select("query_id", "key", F.col("q_word").alias("word"))
    without_word = asked.filter("q_word is null").select("query_id", "key")
    words = with_word.select("word").distinct()
    features = features.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*KEY, *STORED_ORDER, *more, F.explode(_item_keys(masks)).alias("key"))

    out = ["query_id", *KEY, *STORED_ORDER]
    by_word = keyed(hits_by_gram(features, words, KEPT_WORDS if kept_words is None else kept_words), "word").join(with_word, ["word", "key"])
    by_key = _in_blocks(keyed(_small_columns(features)), without_word)
    return by_word.select(*out).unionByName(by_key.select(*out))


#: Queries of one key, and items of one key, that meet at once.
BLOCK = 2_048
#: Up to so many keys, their sizes are sent to the items; the items of more keys are dealt by key.
KEPT_KEYS = 16_384


def _in_blocks(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows joined with all queries of their key.

    A sixth of the items may meet a tenth of the queries in one key. Queries and items of a key are dealt by hash into
    blocks of about ``BLOCK``, and each block of queries meets each of items: the pairs of a key are many tasks', and
    only about two in ``BLOCK`` of them cross the network. The bytes that a task reads don't tell how many pairs it
    makes, so tasks aren't merged by them.
    """
    blocks_of = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks_of(queries, "n_asked").join(blocks_of(rows, "n_items"), "key")
    if queries.select("key").distinct().limit(KEPT_KEYS + 1).count() <= KEPT_KEYS:
        sizes = F.broadcast(sizes)
    own = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(sizes, "key").withColumn("asked", own("n_asked", "query_id"))
    asked = asked.groupBy("key", "asked", "n_items").agg(F.collect_list("query_id").alias("ids")).withColumn("items", every("n_items"))
    sent = rows.join(sizes, "key").withColumn("items", own("n_items", *KEY)).withColumn("asked", every("n_asked"))
    meet, n = ["key", "asked", "items"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.drop("n_asked", "n_items").repartition(n, *meet).join(asked.drop("n_items").repartition(n, *meet), meet)
    return met.withColumn("query_id", F.explode("ids")).drop("ids", "asked", "items")


def _normalised(queries: DataFrame) -> DataFrame:
    given = [F.col(c).isNotNull() for c in ("keyword", "domain", "tag", "status")]
    some = given[0] | given[1] | given[2] | given[3]
    checked = F.when(some, True).otherwise(
        F.raise_error(F.format_string("query %s has no filter", F.col("query_id").cast("string"))).cast("boolean")
    )
    return queries.filter(checked).select(
        "query_id",
        F.nullif(F.lower("keyword"), F.lit("")).alias("q_word"),  # the empty keyword is in every item
        F.lower("domain").alias("q_domain"),
        F.lower("tag").alias("q_tag"),
        F.lower("status").alias("q_status"),
    )


def _small_columns(features: DataFrame, *more: str | Column) -> DataFrame:
    return features.select(
        *KEY,
        F.lower("domain").alias("_domain"),
        F.lower("status").alias("_status"),
        F.transform("tags", F.lower).alias("_tags"),
        *STORED_ORDER,
        *more,
    )


def _mask() -> Column:
    """Which of tag, domain and status a query gives, as bits."""
    given = [F.col(c).isNotNull().cast("int") for c in ("q_tag", "q_domain", "q_status")]
    return given[0] + given[1] * 2 + given[2] * 4


def _key(mask: int | Column, tag: Column, domain: Column, status: Column) -> Column:
    return F.struct((F.lit(mask) if isinstance(mask, int) else mask).alias("mask"), tag.alias("tag"), domain.alias("domain"), status.alias("status"))


def _query_key() -> Column:
    none = F.lit("")
    return _key(F.col("mask"), *[F.coalesce(c, none) for c in ("q_tag", "q_domain", "q_status")])


def _item_keys(masks: list[int]) -> Column:
    """The keys under which queries with the given masks find an item: one, or one for each of its tags."""
    none, every = F.lit(""), []
    for mask in masks:
        domain = F.col("_domain") if mask & 2 else none
        status = F.col("_status") if mask & 4 else none
        if mask & 1:
            every.append(F.transform(F.array_distinct("_tags"), lambda t: _key(mask, t, domain, status)))  # noqa: B023
        else:
            every.append(F.array(_key(mask, none, domain, status)))
    return F.concat(*every) if every else F.array().cast("array<struct<mask:int,tag:string,domain:string,status:string>>")


#: Words whose grams are looked up inside the item's row; more are joined.
KEPT_WORDS = 4_096
#: Share of the items that tells how frequent grams are. It decides which gram a word goes by, never what is found.
SAMPLED_ITEMS = 0.02


def hits_by_gram(features: DataFrame, words: DataFrame, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Small columns and ``word`` for every keyword that occurs in an item.

    An item that contains a keyword contains all its grams of a length, so a word goes by one of them, the
    rarest in a sample of the items. A text is taken apart inside its row and only the grams that a word goes by
    leave it, or with very many words those of letters that such grams have; what they bring too much is taken out by the
    exact test. Up to ``kept_words`` words the grams are a
    constant of the plan and the test follows at once, so texts are read once and never move. With short grams alone,
    each of many words would meet the same share of all items; long ones are few items' own.
    """
    text = F.concat_ws("\u0000", *[F.lower(c) for c in TEXT_FIELDS], F.transform("tags", F.lower))
    length = F.length("word")
    width = F.coalesce(*[F.when(length >= n, n) for n in _GRAMS])
    starts = F.sequence(F.lit(1), F.when(width == 1, 1).otherwise(length - width + 1))
    word_grams = words.select(
        "word", F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("word").substr(i, width)))).alias("gram")
    )
    grams = _grams_like(text, _letters(word_grams.select("gram").distinct()))
    sampled = features.sample(SAMPLED_ITEMS, seed=1).select(F.explode(F.array_distinct(grams)).alias("gram"))
    frequency = sampled.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = stored(
        word_grams.join(frequency, "gram", "left")
        .groupBy("word")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0).cast("long")), F.col("gram"))).alias("gram")),
        "grams",
    )
    texts = [c for c in TEXT_FIELDS if c not in KEY]
    known = rarest.limit(kept_words + 1).collect()
    if len(known) <= kept_words:
        wanted = sorted({r["gram"] for r in known})
        chosen = F.from_json(F.lit(json.dumps(wanted)), "array<string>")
        own = F.array_intersect(_grams_like(text, {(len(g), i, c) for g in wanted for i, c in enumerate(g)}), chosen)
        # lowered once; only a word with the separator in it could be found across two fields
        odd = any("\u0000" in r["word"] for r in known)
        more = [*texts, "tags"] if odd else []
        items = _small_columns(features, text.alias("_text"), own.alias("_grams"), *more).withColumn("gram", F.explode("_grams"))
        found = F.contains("_text", F.col("word"))
        if odd:
            found = found & keyword_predicate(F.col("word"))
        return items.join(F.broadcast(rarest), "gram").filter(found).select(*KEY, *_SMALL, "word")
    item_grams = features.select(*KEY, F.explode(F.array_distinct(_grams_like(text, _letters(rarest)))).alias("gram"))
    candidates = item_grams.join(rarest, "gram").select(*KEY, "word")
    items = _small_columns(features, *texts, "tags")
    return candidates.join(items, list(KEY)).filter(keyword_predicate(F.col("word"))).select(*KEY, *_SMALL, "word")


#: Letters that a place of the looked-for grams may name; with more, any letter will do there.
_LETTERS = 256


def _letters(grams: DataFrame) -> set[tuple[int, int, str]]:
    """(length of gram, place, letter) of all grams of a table; of a place with too many letters, one more than are named."""
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.substring("gram", i + 1, 1).alias("letter")) for i in range(_GRAMS[0])])
    found = grams.select(F.length("gram").alias("size"), F.explode(places).alias("p")).select("size", "p.*").filter("letter <> ''")
    of_place = found.groupBy("size", "place").agg(F.slice(F.collect_set("letter"), 1, _LETTERS + 1).alias("letters"))
    return {(r["size"], r["place"], c) for r in of_place.collect() for c in r["letters"]}


def _grams_like(text: Column, letters: set[tuple[int, int, str]]) -> Column:
    """The grams of a text whose characters are, place by place, among those of the wanted ones: a few of all."""

    def place(size: int, i: int) -> str:
        named = sorted(c for s, p, c in letters if (s, p) == (size, i))
        return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in named) + "]" if len(named) <= _LETTERS else "."

    parts = []
    for size in _GRAMS:
        if any(s == size for s, _, _ in letters):
            pattern = "".join(place(size, i) for i in range(size))
            parts.append(F.regexp_extract_all(text, F.lit(rf"(?s)(?=({pattern}))"), F.lit(1)))
    return F.concat(*parts) if parts else F.array().cast("array<string>")
