"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index has a posting (term, document key, position) for every place in the corpus of the terms that the test items
are searched by: the two rarest of each window, and for proximity the three rarest. Within a document, a posting meets
those of the next WINDOW positions, so two lists are intersected after taking the distance of their terms off the
positions, and no term's postings meet all of another term's. A window is a candidate where its two rarest terms stand
at their distance; candidates are then compared with the document's own words, by a SHA-256 of the window. Terms and
document keys are 64-bit hashes here; a collision adds a candidate at most, never a match.

Proximity matches come from the same postings and meetings: of each window's NEAR_TERMS rarest places whose terms the
corpus has, any two that stand within WINDOW words of each other in a document, in either order. So a window with one
word replaced, or one inserted, is still matched. They are matches of 64-bit terms, not compared with the text.

The terms that words are looked up in are broadcast, BLOCK_TERMS at a time; with more of them the corpus is read in as
many passes, and its words are never shuffled. An index may be kept (`index`), and be searched again.

Defined results: null, empty and wordless texts have no words; an item without words has no window; rows that repeat
id and text share one result; null ids are allowed; with either table empty nothing is hit. Other columns are not
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, small_side

#: What separates words in a text of either case, and once A-Z are lower-cased (fixed by the contract).
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; the rarest places of a window whose pairs are looked up for proximity (one word changed leaves a
#: pair of three); terms in one broadcast (some 40 bytes each).
WINDOW, NEAR_TERMS, BLOCK_TERMS = 13, 3, 1_000_000


def words(text: F.Column) -> F.Column:
    """The text's words; an empty string stands first or last where the text starts or ends with a separator."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR)


def count_words(pieces: F.Column) -> F.Column:
    n = F.size(pieces)
    edges = (F.element_at(pieces, 1) == "").cast("int") + ((n > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (n - edges).cast("long")


def term(word: F.Column) -> F.Column:
    """Words equal but for the case of A-Z have equal terms."""
    return F.xxhash64(F.lower(word))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item, pieces): each test item's words, lower-cased; distinct, without items that have none."""
    pieces = F.filter(words(F.translate("text", UPPER, LOWER)), lambda w: w != "")
    some = items.select("item_id", pieces.alias("pieces")).where(F.size("pieces") > 0).distinct()
    return some.withColumn("item", F.xxhash64("item_id", "pieces"))


def looked_up(found: DataFrame, terms: DataFrame, block: int) -> DataFrame:
    """The rows of found whose term is among terms (a saved table), by a broadcast join for each block of terms."""
    blocks = max(1, -(-terms.count() // block))
    part = F.pmod(F.hash("term"), F.lit(blocks))
    own = [terms if blocks == 1 else terms.where(part == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, [found.join(F.broadcast(x), "term", "left_semi") for x in own])


def corpus_counts(docs: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS) -> DataFrame:
    """How often each of the terms occurs in the corpus; one row per term and task is shuffled."""
    found = docs.select(F.explode(words(F.col("text"))).alias("w")).select(term(F.col("w")).alias("term"))
    return looked_up(found, terms, block).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def windows_of(items: DataFrame, counts: DataFrame, window: int, near_terms: int) -> DataFrame:
    """(item_id, digest, len, a, at_a, b, delta, near): each item's windows whose terms the corpus has.

    b, the term of one of the two rarest places, stands delta words behind a, the other's, which is the at_a-th of the
    window; a one-word window has the same for both. near: the terms of the near_terms rarest places that occur.
    """
    placed = items.select("item", F.posexplode("pieces").alias("at", "w")).select("item", "at", term(F.col("w")).alias("term"))
    own = F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term")
    x = placed.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(own)).alias("t")).join(items, "item")
    wins = F.expr(f"""
        transform(sequence(0, greatest(size(t) - {window}, 0)), s -> struct(
            s AS start, least(size(t), {window}) AS len,
            unhex(sha2(concat_ws(' ', slice(pieces, s + 1, {window})), 256)) AS digest,
            array_sort(transform(slice(t, s + 1, {window}), e -> struct(e.n AS n, e.at AS at, e.term AS term))) AS by_n))""")
    x = x.select("item_id", F.explode(wins).alias("w")).select("item_id", "w.*")
    first, second = F.col("by_n")[0], F.coalesce(F.get("by_n", F.lit(1)), F.col("by_n")[0])
    pair = F.array_sort(F.array(*[F.struct(r["at"].alias("at"), r["term"].alias("term")) for r in (first, second)]))
    near = F.slice(F.filter("by_n", lambda r: r["n"] > 0), 1, near_terms)["term"]
    x = x.select("item_id", "digest", "len", "start", pair.alias("pair"), first["n"].alias("least"), near.alias("near"))
    a, b = F.col("pair")[0], F.col("pair")[1]
    places = [a["term"].alias("a"), (a["at"] - F.col("start")).alias("at_a"), b["term"].alias("b"), (b["at"] - a["at"]).alias("delta")]
    return x.select("item_id", "digest", "len", "least", "near", *places)


def near_pairs(wins: DataFrame) -> DataFrame:
    """(term, term2, item_id): the pairs among each window's rarest places, the lesser term first."""
    rare = wins.select("item_id", "near").distinct().select("item_id", F.posexplode("near").alias("i", "x"), "near")
    two = rare.select("item_id", "i", "x", F.posexplode("near").alias("j", "y")).where("i < j")
    return two.select(F.least("x", "y").alias("term"), F.greatest("x", "y").alias("term2"), "item_id").distinct()


def build_index(docs: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS) -> DataFrame:
    """The postings (term, dkey, pos) of the terms; docs has (dkey, text). pos counts from the first piece of the text."""
    found = docs.select("dkey", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    return looked_up(found.select("dkey", "pos", term(F.col("w")).alias("term")), terms, block).select("term", "dkey", "pos")


def meetings(postings: DataFrame, within: int) -> DataFrame:
    """(dkey, term, pos, term2, pos2): each posting with those of its document up to `within` positions further on."""
    ahead = Window.partitionBy("dkey").orderBy("pos").rangeBetween(1, within)
    once = postings.dropDuplicates(["dkey", "pos"])  # rows that repeat id and text share postings
    x = once.withColumn("next", F.collect_list(F.struct(F.col("term").alias("term2"), F.col("pos").alias("pos2"))).over(ahead))
    return x.select("dkey", "term", "pos", F.explode("next").alias("m")).select("dkey", "term", "pos", "m.*")


def candidates(postings: DataFrame, met: DataFrame, wins: DataFrame) -> DataFrame:
    """(dkey, start, len, digest): the places where a window's two rarest terms stand at their distance."""
    apart = F.col("pos2") - F.col("pos") == F.col("delta")
    x = met.join(wins, (F.col("term") == F.col("a")) & (F.col("term2") == F.col("b")) & apart)
    alone = postings.join(wins.where("delta = 0"), F.col("term") == F.col("a"))
    cols = ["dkey", (F.col("pos") - F.col("at_a")).alias("start"), "len", "digest"]
    return x.select(*cols).unionByName(alone.select(*cols)).where("start >= 0")


def proximity_matches(met: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where two terms of a pair meet, in either order: (dkey, term, term2, pos, pos2), pos being that of term, the lesser."""
    flip = F.col("term") > F.col("term2")
    either = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
    x = met.select("dkey", either("term2", "term").alias("term"), either("term", "term2").alias("term2"), either("pos2", "pos").alias("pos"), either("pos", "pos2").alias("pos2"))
    return x.join(pairs, ["term", "term2"], "left_semi")


def verified(keyed: DataFrame, maybe: DataFrame) -> DataFrame:
    """(dkey, n_hit, digests): the words hit and the windows found, of the documents whose own words confirm a candidate.

    maybe: (dkey, maybe) with a document's distinct candidates, which are no more than its places and the windows whose
    two rarest terms stand there.
    """
    own = F.explode(F.array(words(F.translate("text", UPPER, LOWER)))).alias("own")  # once a document, not once a candidate
    texts = keyed.join(maybe, "dkey").select("dkey", "maybe", own)
    sure = F.expr("filter(maybe, c -> unhex(sha2(concat_ws(' ', slice(own, c.start + 1, c.len)), 256)) = c.digest)")
    covered = F.expr("""
        aggregate(array_sort(transform(sure, c -> struct(CAST(c.start AS bigint) AS start, c.len AS len))),
            struct(CAST(0 AS bigint) AS n, CAST(0 AS bigint) AS to),
            (a, s) -> struct(a.n + greatest(CAST(0 AS bigint), s.start + s.len - greatest(a.to, s.start)) AS n,
                             greatest(a.to, s.start + s.len) AS to)).n""")
    x = texts.select("dkey", F.explode(F.array(sure)).alias("sure")).where(F.size("sure") > 0)
    x = x.select("dkey", covered.alias("n_hit"), F.array_distinct(F.transform("sure", lambda c: c["digest"])).alias("digests"))
    return x.dropDuplicates(["dkey"])  # rows that repeat id and text; their words are gone by now


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    within: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    index: str | None = None,
    only_hits: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Exact phrase matches, a row per document: doc_id, n_words, n_hit, n_items, items_sha256, items, n_near, dkey; and,
    unless `within` is 0, the proximity matches (dkey, item_id, pos, pos2) of terms within so many words of each other,
    of whose items n_near are in the document.

    pos and pos2 count from the text's first piece, pos being of the lesser term. index: a folder that keeps the postings.
    only_hits: documents without a match are left out, so that only the others' words are counted.
    """
    store = Store(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("dkey", F.xxhash64("doc_id", "text"))
    items = store.save(item_words(benchmark), "items")
    vocabulary = store.save(items.select(F.explode("pieces").alias("w")).select(term(F.col("w")).alias("term")).distinct(), "vocabulary")
    counts = store.save(corpus_counts(docs, vocabulary, block_terms), "counts")
    wins = store.save(windows_of(items, small_side(counts, store, "counts"), window, NEAR_TERMS), "windows")
    exact = store.save(wins.where("least > 0").select("digest", "len", "a", "at_a", "b", "delta").distinct(), "exact")
    terms = exact.select(F.col("a").alias("term")).union(exact.select("b"))
    if within:
        pairs = store.save(near_pairs(wins), "pairs")
        terms = terms.union(pairs.select("term")).union(pairs.select("term2"))
    terms = store.save(terms.distinct(), "terms")
    postings = build_index(keyed, terms, block_terms)
    if index:
        postings.write.mode("overwrite").parquet(index)
        postings = docs.sparkSession.read.parquet(index)
    else:
        postings = store.save(postings, "postings")
    met = meetings(postings, max(within, window - 1))
    met = store.save(met, "met") if within else met
    maybe = candidates(postings, met, small_side(exact, store, "exact")).groupBy("dkey").agg(F.collect_set(F.struct("start", "len", "digest")).alias("maybe"))
    maybe = store.save(maybe, "maybe")
    hits = store.save(verified(keyed, small_side(maybe, store, "maybe")), "hits")
    of = store.save(wins.select("digest", F.col("item_id").cast("string").alias("item")).distinct(), "of")
    items_of = hits.select("dkey", F.explode("digests").alias("digest")).join(small_side(of, store, "of"), "digest")
    found = items_of.groupBy("dkey").agg(F.array_sort(F.collect_set("item")).alias("items")).join(hits.select("dkey", "n_hit"), "dkey")
    near, counts_near = None, F.lit(0).cast("long").alias("n_near")
    if within:
        of_pairs = small_side(pairs, store, "pairs")
        close = proximity_matches(met.where(F.col("pos2") - F.col("pos") <= within), of_pairs).join(of_pairs, ["term", "term2"])
        near = store.save(close.select("dkey", "item_id", "pos", "pos2").distinct(), "near")
        n_near = near.groupBy("dkey").agg(F.count_distinct("item_id").alias("n_near"))
        found, counts_near = found.join(n_near, "dkey", "full"), "n_near"
    found = store.save(found.select(F.col("dkey").alias("hit_key"), "items", "n_hit", counts_near), "found")
    side, same = small_side(found, store, "found"), F.col("dkey") == F.col("hit_key")
    x = keyed.join(side, same) if only_hits else keyed
    # the words stand in a column of their own, so that they are found once, whatever is asked of them
    x = x.withColumn("pieces", F.explode(F.array(words(F.col("text"))))).withColumn("n_words", count_words(F.col("pieces"))).drop("text", "pieces")
    x = x if only_hits else x.join(side, same, "left")  # without the text, which then is not shuffled
    own, some = F.coalesce("items", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    digest = F.sha2(F.concat_ws(",", own), 256).alias("items_sha256")
    x = x.select("doc_id", "n_words", some("n_hit"), F.size(own).cast("long").alias("n_items"), digest, own.alias("items"), some("n_near"), "dkey")
    store.drop("items", "vocabulary", "counts", "windows", "exact", "terms", "maybe", "hits", "of", "met", *(() if index else ("postings",)))
    return x, near


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **options: object) -> DataFrame:
    """Exact phrase matches, with contaminated: some word is hit, and at least one in `share` words."""
    return judged(search(docs, benchmark, window, 0, **options)[0], share).drop("n_near")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, within: int = WINDOW, id_col: str = "doc_id", **options: object) -> tuple[DataFrame, DataFrame]:
    """What decontaminate gives, with n_near, and the proximity matches (doc_id, item_id, pos, pos2) themselves, all from the same postings."""
    hits, near = search(docs, benchmark, window, within, id_col, **options)
    owners = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, options.get("text_col", "text")).alias("dkey")).distinct()
    return judged(hits, share), near.join(owners, "dkey").select("doc_id", "item_id", "pos", "pos2")


def judged(hits: DataFrame, share: int) -> DataFrame:
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
