"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, exact_dedup, language, licenses, mixing, sharding, simhash, toxicity
from sparkloom.llm.license_texts import KNOWN
from sparkloom.llm.store import Store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bucket int, piece string, fp string, dkey int, item string, shard string, term string"
VOCABULARY = ["the", "of", "ünder", "Straße", "x", "re-do", "42", "ARE", "a\tb", "ﬁn", "日本", "q" * 9]


def rows_of(texts, sources=None):
    return [(i, t, "en", None if sources is None else sources[i % len(sources)], 0, -1, "k", 0, "p", "f", 1, "i", "s", "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    made = [" ".join(r.choice(VOCABULARY) for _ in range(r.choice((1, 3, 8, 40, 200)))) for _ in range(150)]
    made += [made[0]] * 60 + [made[1].replace(" ", "  \n")] * 5 + [None, None, "", "  \t", "...", "the", "The"]
    made += [" ".join(r.choice(VOCABULARY) for _ in range(30_000))]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts, ["b", "a", None, "c", "a", "a"])
    rows += [rows[3], rows[3], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("options", [{}, {"heavy": 16, "counters": 40, "least": 2}])
def test_exact_dedup(docs, options):
    groups = defaultdict(list)
    all_rows = docs.select("doc_id", "text").collect()
    for r in all_rows:
        groups[norm(r.text)].append(r.doc_id)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, **options).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_misra_gries_finds_hot_digests(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"d{i}") for i in range(3000)], "doc_id long, text_sha256 string").repartition(7)
    hot = exact_dedup.hot_digests(df, 3000, heavy=8, counters=16, least=1).collect()
    assert [(r.text_sha256, r.keep_id, r.group_size) for r in hot] == [("hot", 1, 2000)]


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert decontaminate.decontaminate(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    filters = language.learn(empty.select("doc_id", "text", "lang"))
    assert language.predict(empty, filters).count() == 0
    assert toxicity.score_documents(empty, empty.select("doc_id", F.lit(1).alias("toxic")), F.lit(True)).count() == 0


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed, target = share * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | target
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(docs):
    got = mixing.mix(docs, bucket_rows=20).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r.doc_id, count(r.text), r.source) for r in docs.collect())
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    taken, cut = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        cut[r.source] += r.size > 0 and r.taken % r.size > 0
    for s in sizes:
        assert taken[s] == round(want[s])
        assert cut[s] <= 1
    again = mixing.mix(docs.repartition(3), bucket_rows=20).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_targets_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 60)
    r = random.Random(4)
    sizes = {f"host{i}.example": int(r.paretovariate(0.6) * 10) for i in range(500)} | {None: 70, "": 0, "Z": 5}
    store = Store(spark, "test")
    sources = store.save(spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(3), "sources")
    got = {x.source: x.target for x in mixing.targets(sources, store).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_cuts_take_whole_documents(docs):
    mixed = mixing.mix(docs)
    cuts = {r.source: r for r in mixing.cuts(mixed).collect()}
    for r in mixed.collect():
        c = cuts[r.source]
        times = c.full + (c.cut is not None and r.key <= c.cut)
        if r.size:
            assert abs(times - r.taken / r.size) <= 0.5


# --- sharding


@pytest.mark.parametrize("options", [{}, {"large": 2, "task_groups": 40, "slot_rows": 3}])
def test_sharding(docs, options):
    got = sharding.shard(docs, 5, **options).collect()
    source = docs.collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    homes = defaultdict(set)
    for r in got:
        homes[(r.text_crc32, r.size)].add(r.shard)
    shared = Counter((size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    limit = sum(map(size, (r.text for r in source))) / 5
    assert all(len(h) == 1 or s * shared[(s, c)] > limit for (c, s), h in homes.items())


def test_sharding_balance(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, "w " * min(int(r.paretovariate(1.1) * 5), 2000)) for i in range(4000)] + [(5000 + i, "hot " * 20) for i in range(2000)], "doc_id long, text string")
    got = sharding.shard(df, 8, task_groups=500).toPandas().groupby("shard").agg(size=("size", "sum"), n=("size", "count"))
    assert got["size"].max() <= 1.02 * got["size"].mean()


def test_a_group_of_many_rows_and_few_bytes_stays_whole(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(800)] + [(5000 + i, "x") for i in range(200)], "doc_id long, text string")
    got = sharding.shard(df, 32).toPandas()
    assert got[got["doc_id"] >= 5000]["shard"].nunique() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 32 and sizes.max() <= 1.1 * sizes.mean()


def test_a_group_of_more_bytes_than_a_shard_is_split(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(800)] + [(5000 + i, "equal " * 80) for i in range(800)], "doc_id long, text string")
    got = sharding.shard(df, 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert got[got["doc_id"] >= 5000]["shard"].nunique() > 1 and sizes.max() <= 1.1 * sizes.mean()


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), sharding.WEIGHTS])
def test_packing_is_that_of_plain_loops(weights):
    r = np.random.default_rng(5)
    sizes, shards, turn = r.random((300, 3)) / 100, 7, 3
    left = [[1 / shards] * 3 for _ in range(shards)]
    want = []
    for own in sizes:
        score = lambda k: sum(w * x * y for w, x, y in zip(weights, left[k], own, strict=True))
        best = max(((k + turn) % shards for k in range(shards)), key=lambda k: round(score(k), 15))
        left[best] = [x - y for x, y in zip(left[best], own, strict=True)]
        want.append(best)
    residual = np.full((shards, 3), 1 / shards)
    got = sharding.pack(sizes, residual, turn, weights)
    assert got.tolist() == want and np.allclose(residual, left)


def test_packing_takes_the_highest_dot_product():
    residual = np.array([[1.0, 0.1], [0.1, 1.0]])
    assert sharding.pack(np.array([[0.5, 0.0], [0.0, 0.5]]), residual, 0, (1.0, 1.0)).tolist() == [0, 1]


# --- decontamination


def words(t):
    lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            for k in range(len(own) - n + 1):
                if own[k : k + n] == w[s : s + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
    ids = sorted(found)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)


def test_decontamination(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "İx", "K", "ΟΔΟΣ", "the"] + ["the"] * 20
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.choice((3, 12, 13, 14, 30, 60))))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "w1 w1"), (9, "the the the"), (104, "ODD ΟΔΟΣ. word")]
    items.append(items[0])
    texts = [None, "", "!!", "w1 W1 w1", "odd οδοσ word", "Odd ΟΔΟΣ Word", "..the the-the, the"]
    for _ in range(60):
        out = say(r.choice((5, 40, 150)))
        for _ in range(r.choice((0, 1, 1, 3))):
            got = words(r.choice(items)[1])
            a = r.randrange(max(1, len(got)))
            k = r.randrange(len(out) + 1)
            out[k:k] = [x.upper() if r.random() < 0.3 and x.isascii() else x for x in got[a if r.random() < 0.5 else 0 :]]
        texts.append(r.choice(("", " ", "-- ")) + r.choice((" ", ", ", "\n")).join(out) + r.choice(("", ".")))
    texts += [texts[9]] * 30
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[8]), (None, texts[10])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, dkey int, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench).collect()
    want = Counter((i, *brute_hits(t, items)) for i, t in rows)
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
    assert sum(x[2] > 0 for x in want) > 20


def test_decontamination_beyond_the_broadcast_limit(spark, monkeypatch, tmp_path):
    from sparkloom.llm import store

    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "w1 w2 w3 w1 w2 w3 w1")]
    own = [(1, "a b " + items[0][1]), (2, "w1 w2 w3"), (3, " ".join(f"w{i}" for i in range(4, 20))), (4, (items[1][1] + " x ") * 10_000), (4, (items[1][1] + " x ") * 10_000)]
    df, bench = spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.n_hit, x.n_items) for x in decontaminate.decontaminate(df, bench, block_terms=3).collect())
    assert got == {(1, 20, 1): 1, (2, 0, 0): 1, (3, 16, 1): 1, (4, 70_000, 1): 2}
    hits, near = decontaminate.search(df, bench, index=str(tmp_path / "index"))
    assert {(x.doc_id, x.n_hit) for x in hits.collect()} == {(1, 20), (2, 0), (3, 16), (4, 70_000)}
    assert spark.read.parquet(str(tmp_path / "index")).columns == ["term", "dkey", "pos"]


def test_meetings_and_proximity(spark):
    postings = spark.createDataFrame([(1, 7, 0), (2, 7, 3), (2, 7, 9), (1, 8, 5), (2, 8, 1)], "term long, dkey long, pos int")
    met = decontaminate.meetings(postings, 4)
    assert sorted(map(tuple, met.collect())) == [(7, 1, 0, 2, 3), (8, 2, 1, 1, 5)]
    pairs = spark.createDataFrame([(5, 1, 2)], "item_id long, term long, term2 long")
    assert sorted(map(tuple, decontaminate.proximity_matches(met, pairs).select("dkey", "pos", "pos2").collect())) == [(7, 0, 3), (8, 5, 1)]


def test_proximity_matches_of_changed_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    filler = " ".join(f"filler{k}" for k in range(60))
    texts = {1: [*item], 2: [*item[:6], "inserted", *item[6:]], 4: [*reversed(item)], 5: ["nothing", "here"], 6: [item[0], *filler.split(), item[1], *filler.split(), item[2]]}
    texts |= {100 + k: [*item[:k], "swapped", *item[k + 1 :]] for k in range(len(item))}
    docs = spark.createDataFrame([(k, " ".join(["before", *v, "after"])) for k, v in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "alpha unheard"), (9, "nowhere")], "item_id long, text string")
    hits, near = decontaminate.matches(docs, benchmark)
    assert {r.doc_id for r in hits.where("n_hit > 0").collect()} == {1}
    rows = near.collect()
    assert {r.item_id for r in rows} == {7} and {r.doc_id for r in rows} == set(texts) - {5, 6}
    assert all(0 < abs(r.pos - r.pos2) <= decontaminate.WINDOW for r in rows) and len(rows) == len(set(rows))
    assert {r.doc_id for r in hits.where("n_near > 0").collect()} == set(texts) - {5, 6}
    assert sorted(map(str, hits.drop("dkey", "n_near").collect())) == sorted(map(str, decontaminate.decontaminate(docs, benchmark).drop("dkey").collect()))


# --- licences


def test_licenses(spark):
    mit = KNOWN["MIT"]
    texts = {
        1: mit, 2: mit.replace("<year> <copyright holders>", "2031 Ünal & Söhne").upper(), 3: mit.replace("License", "Licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("\n", "\r\n  "),
        4: mit + " and more", 5: None, 6: "", 7: "Copyright 2020 me", 8: KNOWN["BSD-3-Clause"].replace("holder", "owner"), 9: KNOWN["Apache-2.0 (notice)"].replace("http:", "https:"), 10: "licensed under the apache licence version 2.0", 11: mit.replace("Copyright (c) <year> <copyright holders>", ""), 12: "x" * 200_000,
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(1, mit, "x"), (None, mit, "x")], "doc_id long, text string, license_id string")
    got = sorted(((r.doc_id or 0, r.license_id) for r in licenses.scan(df).collect()), key=str)
    want = {1: "MIT", 2: "MIT", 3: "MIT", 8: "BSD-3-Clause", 9: "Apache-2.0 (notice)", 10: "Apache-2.0 (line)", 11: "MIT"}
    assert got == sorted([(k, want.get(k)) for k in texts] + [(1, "MIT"), (0, "MIT")], key=str)
    assert licenses.known_licenses(spark).select("canonical_sha256").distinct().count() == len(KNOWN)


def test_canonical_texts_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from sparkloom.llm.queries import canonical_sql

    r = random.Random(3)
    words_ = ["licence", "Licenced", "sub", "license", "sub licence", "non-infringement", "non", "infringement", "copyright owner", "Copyright", "owners", "(c)", "© 2020", "\n", "\n  copyright 2001 me\n", "\nPortions Copyright x", "All Rights Reserved.", "https://x.y/z", "organisation", "authorised", "recognise", "authors", "favourable", "whilst", "per", "cent", "per cent", "’quoted’", "—", "élicence", "日本", "x_y", "", "\t", "\r\n", "ris", "a.b"]
    texts = [" ".join(r.choice(words_) for _ in range(r.randint(0, 30))) for _ in range(400)] + [*KNOWN.values()][:60]
    got = [x.c for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licenses.canonical(F.col("t")).alias("c")).orderBy("i").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INT, t VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = [x for (x,) in c.execute(f"SELECT {canonical_sql('t')} FROM t ORDER BY i").fetchall()]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="needs the system's licence texts")
def test_complete_licenses_are_known(spark):
    whole = {n: open(f"/usr/share/common-licenses/{n}").read() for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0")}
    bare = lambda x: KNOWN[x].split("\n\n", 1)[1]
    whole |= {"Apache, cut": whole["Apache-2.0"].split("APPENDIX")[0], "GPL, cut": whole["GPL-3"].split("How to Apply")[0], "GPL, older": whole["GPL-2"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), "Apache, unwrapped": re.sub(r"(?<=\S)\n *(?=\S)", " ", whole["Apache-2.0"])}
    whole |= {x: bare(x) for x in ("ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")} | {"BSD, bullets": re.sub(r"(?m)^\d\.", "*", bare("BSD-3-Clause")), "MIT": KNOWN["MIT"].replace("MIT License", "The MIT License (MIT)")}
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([*whole.items()], "doc_id string, text string")).collect()}
    assert all(v and v.split("-")[0].split(" ")[0] == k.split("-")[0].split(",")[0] for k, v in got.items()), got
    assert got["GPL-2"] == "GPL-2.0" and got["LGPL-2.1"] == "LGPL-2.1" and got["Apache, cut"] == "Apache-2.0 (without appendix)"


# --- simhash


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, distance=4):
    own = {f: min(i for g, i in zip(fps, ids, strict=True) if g == f) for f in set(fps)}
    left, out = set(own), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            f = front.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= distance}
            left -= near
            front += near
        out |= dict.fromkeys(group, min(own[f] for f in group))
    return [out[f] for f in fps]


def test_fingerprints(docs):
    got = simhash.near_dedup(docs.where("doc_id IS NOT NULL").limit(400)).collect()
    by_id = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        assert int(r.fingerprint, 16) == brute_fingerprint(by_id[r.doc_id]) and len(r.fingerprint) == 16
    fps, ids = [int(r.fingerprint, 16) for r in got], [r.doc_id for r in got]
    assert [r.component_id for r in got] == brute_components(fps, ids)


def test_all_null_ids_have_no_component(spark):
    got = simhash.near_dedup(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [None, None]


class Given:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("split", [False, True])
def test_links_are_complete(split, dense):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [*base]
    for f in base:
        for _ in range(20):
            g = int(f)
            for b in r.choice(64, r.integers(1, 6), replace=False):
                g ^= 1 << int(b)
            fps.append(np.uint64(g))
    fps = np.unique(np.array(fps, np.uint64))
    import pyarrow as pa

    parts = Given(r.integers(0, 3, 1 << simhash.SLOT_BITS).astype(np.uint8)) if split else None
    sent = list(simhash.send(4, dense, 3, parts)(iter([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])])))
    links = []
    for task in range(3):
        mine = [b.filter(pa.array([t == task for t in b.column(0).to_pylist()])) for b in sent]
        for out in simhash.compare(4, small=5)(iter(mine)):
            links += list(zip(out.column(0).to_numpy().view(np.uint64).tolist(), out.column(1).to_numpy().view(np.uint64).tolist(), strict=True))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    ids = [int(f) for f in fps]
    assert [find(f) for f in ids] == brute_components(ids, ids)


def test_split_anchors_give_the_same(spark):
    r = random.Random(2)
    words_ = [f"w{i}" for i in range(400)]
    base = [r.choice(words_) for _ in range(300)]
    texts = []
    for _ in range(300):
        t = list(base)
        t[r.randrange(300)] = r.choice(words_)
        texts.append(" ".join(t))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    a = simhash.near_dedup(df).collect()
    for dense_from in (1, simhash.DENSE):
        b = simhash.near_dedup(df, cell=20, task_entries=20_000, dense_from=dense_from).collect()
        assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    assert max(Counter(r.component_id for r in a).values()) > 50


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (7, 7), (3, 1), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), Store(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {100: 50, 60: 50, 201: 200}


def test_small_graphs_take_few_files(spark, monkeypatch):
    """Where shuffles deal out to many partitions too: each file that an executor writes can cost it processes."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files, save = {k: spark.conf.get(k) for k in names}, {}, Store.save

    def counted(self, df, name):
        out = save(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Store, "save", counted)
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(900, numPartitions=2).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 30).alias("b"))
        got = components.components(links, Store(spark, "test")).collect()
        words = [(k, f"{'a b c d e f g h ' * 4}{k % 50}") for k in range(100)]
        assert simhash.near_dedup(spark.createDataFrame(words, "doc_id long, text string")).count() == 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x.node, x.root) for x in got) == [(k, k - k % 30) for k in range(900) if k % 30]
    assert "roots" not in files  # the components are read from where they were written last
    assert max(n for name, n in files.items() if name == "named" or "links-" in name and name != "links-0") <= 6


def test_components_with_hot_nodes(spark):
    r = random.Random(8)
    links = [(5000, i) for i in range(3000)] + [(r.randrange(4000, 5000), r.randrange(4000, 5000)) for _ in range(400)] + [(7000 + i // 9, 9000 + i) for i in range(900)] + [(2999, 7001)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long"), Store(spark, "test")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_codes_cover():
    for code in (simhash.GOLAY, simhash.HAMMING):
        syndromes, patterns = simhash.tables(code, 0)
        assert len(syndromes) == 1 << code.bits and (patterns[0] >= 0).all() and patterns[0].shape == (1 << code.check, 1)


# --- language


def test_learning_writes_no_files(spark, monkeypatch):
    """Each file that an executor writes can cost it processes, and the n-grams are read only once."""

    def refused(self, df, name):
        raise AssertionError(f"{name} is written")

    monkeypatch.setattr(Store, "save", refused)
    rows = [(k, "kalo mika loka" if k % 2 else "schrück entück", "aa" if k % 2 else "bb") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs)
    assert {(x.doc_id, x.lang_pred) for x in language.predict(docs, filters).collect()} == {(k, lang) for k, _, lang in rows}


def test_language(spark):
    r = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "ück", "ent"], "cc": ["ción", "lla", "ñu"]}
    say = lambda x, n: " ".join("".join(r.choice(syllables[x]) for _ in range(r.randint(2, 4))) for _ in range(n))
    rows = [(i, say(x, r.randint(3, 60)), x if r.random() > 0.03 else "aa") for i, x in enumerate(["aa", "bb", "cc"] * 200)]
    held = [(1000 + i, say(x, 8), x) for i, x in enumerate(["aa", "bb", "cc"] * 30)]
    odd = [(2000, None, "aa"), (2001, "", "aa"), (2002, "12 34 !?", "aa"), (2003, "日本", None), (2004, "kalomi " * 30_000, None), (None, "kalomi kalo", None)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in language.predict(spark.createDataFrame(held + odd, "doc_id long, text string, lang string"), filters).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in held) >= 88
    assert [got[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3
    assert got[2004].lang_pred == "aa" and got[None].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = language.keep_known(spark.createDataFrame(held + odd, "doc_id long, text string, lang string"), filters).collect()
    assert {x.doc_id for x in kept} == {i for i, *_ in held} | {2004, None}
    assert all(x.lang == got[x.doc_id].lang_pred for x in kept)


def test_predictions_are_those_of_brute_sets(spark):
    """Sets of strings in place of hashes and filters, and counts of documents in place of a sample."""
    r = random.Random(11)
    own = {x: ["".join(r.choice("abcdeéßñ") for _ in range(3)) for _ in range(9)] for x in ("aa", "bb", "cc", "dd")}
    say = lambda x, n: " ".join(r.choice(own[x]) + r.choice(own[x]) for _ in range(n))
    rows = [(i, say(x, 15) + (" " + say("dd", 4) if r.random() < 0.05 else ""), x if r.random() > 0.04 else "aa") for i, x in enumerate(["aa", "bb", "cc", "dd", "dd"] * 60)]

    def grams(t):
        s = re.sub(r"[\W\d_]", " ", f" {t.lower()} ")
        every = [s[k : k + n] for n in (3, 4) for k in range(len(s) - n + 1)]
        return [g for g in every if " " not in g[1:-1]]

    docs = Counter(x for _, _, x in rows)
    seen = Counter((x, g) for _, t, x in rows for g in set(grams(t)))
    best = defaultdict(float)
    for (x, g), n in seen.items():
        best[g] = max(best[g], n / docs[x])
    has = {x: {g for (y, g), n in seen.items() if y == x and n / docs[x] >= language.NEAR * best[g]} for x in docs}
    held = [(1000 + i, say(x, r.randint(1, 9)) + r.choice(("", " xyz qqq", " 12")), x) for i, x in enumerate(["aa", "bb", "cc", "dd"] * 25)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), filters).collect()}
    for i, t, _ in held:
        every = grams(t)
        counts = {x: sum(g in has[x] for g in every) / len(every) for x in docs}
        assert counts[got[i].lang_pred] >= max(counts.values()) - 0.02 and got[i].score == pytest.approx(counts[got[i].lang_pred], abs=0.02)


def test_bloom_filters_have_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = language.Filters.build(["x", "y"], [h[:10_000], h[10_000:]])
    got = f.contained(h)
    assert (got[:10_000] & np.uint64(1)).all() and (got[10_000:] & np.uint64(2)).all()
    assert ((got[:10_000] & np.uint64(2)) > 0).mean() < 0.01
    assert np.allclose(f.false_share, [((f.masks >> np.uint64(b)) & np.uint64(1)).mean() ** 3 for b in (0, 1)])


def test_over_64_languages_are_learned(spark):
    r = random.Random(5)
    own = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüßéñ") for _ in range(6)) for _ in range(12)] for k in range(130)}
    rows = [(i, " ".join(r.choice(own[x]) for _ in range(20)), x) for i, x in enumerate(list(own) * 4)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.masks.shape[1] == 3 and sorted(filters.names) == list(own)
    held = [(i, " ".join(r.choice(own[x]) for _ in range(10)), x) for i, x in enumerate(own)]
    got = language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), filters).collect()
    assert [x.lang_pred for x in sorted(got, key=lambda x: x.doc_id)] == list(own)


# --- toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(6)
    syllables = ["an", "the", "or", "ti", "es", "in", "wh", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.2
        own = [word() for _ in range(r.randint(5, 200))]
        for _ in range(3 if bad else 0):
            own.insert(r.randrange(len(own)), r.choice(["gragh", "blurk"]) + r.choice(syllables))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "!!"), (2003, "an the or " * 30_000 + "gragh blurk"), (None, "an the or")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels


def test_toxicity(spark, toxic):
    docs, labels = toxic
    table = spark.createDataFrame([*labels, (0, None), (None, 1), labels[1]], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, table, F.col("doc_id") % 3 != 1).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 1]
    assert sum((s >= 0.7) == y for s, y in held) >= 0.98 * len(held)
    assert got[2000] == got[2001] == got[2002] and 0.1 < got[2000] < 0.3
    assert all(0 <= s <= 1 for s in got.values())
    one = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, one, F.lit(True)).collect()} == {0.0}


class BruteKneserNey:
    """The same model by dictionaries of strings: words is a list of (word, documents with it: toxic, ordinary)."""

    def __init__(self, words_):
        n, self.d, self.more = toxicity.ORDER, toxicity.DISCOUNT, toxicity.SHARED
        self.n, self.top, self.grams = n, Counter(), defaultdict(set)
        for w, *counts in words_:
            s = "\x01" * (n - 1) + w + "\x02"
            for i in range(n - 1, len(s)):
                for k in range(1, n + 1):
                    self.grams[k].add(s[i - k + 1 : i + 1])
                for c, x in enumerate(counts):
                    self.top[c, s[i - n + 1 : i + 1]] += x
        self.before = {k: Counter(g[1:] for g in self.grams[k + 1]) for k in range(1, n)}
        self.sums = {k: Counter() for k in self.before}
        for k, every in self.before.items():
            for g, x in every.items():
                self.sums[k][g[:-1]] += x
        self.follow = {k: Counter(g[:-1] for g in self.grams[k]) for k in range(1, n + 1)}
        self.total = Counter()
        self.types = Counter()
        for (c, g), x in self.top.items():
            self.total[c, g[:-1]] += x
            self.types[c, g[:-1]] += x > 0

    def below(self, g):
        if not g:
            return 1 / len(self.grams[1])
        k, rest = len(g), self.below(g[1:])
        total = self.sums[k][g[:-1]]
        return (max(self.before[k][g] - self.d, 0) + self.d * self.follow[k][g[:-1]] * rest) / total if total else rest

    def evidence(self, w):
        s, out = "\x01" * (self.n - 1) + w + "\x02", 0.0
        for i in range(self.n - 1, len(s)):
            g, rest = s[i - self.n + 1 : i + 1], self.below(s[i - self.n + 2 : i + 1])
            both = self.total[0, g[:-1]] + self.total[1, g[:-1]]
            if both:
                rest = (max(self.top[0, g] + self.top[1, g] - self.d, 0) + self.d * self.follow[self.n][g[:-1]] * rest) / both
            for c, sign in ((0, 1), (1, -1)):
                total = self.total[c, g[:-1]]
                p = (max(self.top[c, g] - self.d, 0) + (self.d * self.types[c, g[:-1]] + self.more) * rest) / (total + self.more) if total else rest
                out += sign * np.log(p)
        return out


@pytest.fixture(scope="module")
def counted(spark, toxic):
    docs, labels = toxic
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = docs.join(known, "doc_id").select("doc_id", "text", F.pmod("doc_id", F.lit(5)).cast("int").alias("fold"), "toxic")
    rows = rows.withColumn("fold", F.when(F.col("fold") < toxicity.FOLDS, F.col("fold")).otherwise(-1)).cache()
    return rows.collect(), toxicity.Counted.gather(toxicity.count_grams(rows))


def brute_words(rows):
    n = Counter((w, r.toxic) for r in rows for w in set(re.findall(r"\w+", r.text.lower())))
    return [(w, n[w, 1], n[w, 0]) for w in {w for w, _ in n}]


def test_evidence_is_that_of_brute_kneser_ney(counted):
    rows, own = counted
    model, brute = own.model(), BruteKneserNey(brute_words(rows))
    some = ["graghan", "theor", "graghzz", "x", "anthe", "ouesesin", "日本", "blurkou", "g"] + [w for w, *_ in brute_words(rows)[:200]]
    assert np.allclose(model.evidence(some), [brute.evidence(w) for w in some], atol=1e-4)
    assert model.evidence(["graghan"])[0] > 2 > abs(model.evidence(["theor"])[0])
    assert model.evidence(["graghzz"])[0] > 1  # not seen, but it begins like one that was


def test_a_part_is_left_out_exactly(counted):
    rows, own = counted
    model = own.model(2)
    brute = BruteKneserNey(brute_words([r for r in rows if r.fold != 2]))
    some = ["graghan", "theor", "graghzz"] + [w for w, *_ in brute_words(rows)[:200]]
    assert np.allclose(model.evidence(some), [brute.evidence(w) for w in some], atol=1e-4)


def test_scores_from_few_toxic_documents_rise_with_toxicity(spark, toxic):
    docs, labels = toxic
    few = [x for x in labels if x[1]][:3] + [x for x in labels if not x[1]][:40]
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(few, "doc_id long, toxic int"), F.lit(True)).collect()}
    mean = [np.mean([got[i] for i, y in labels if y == c]) for c in (0, 1)]
    assert mean[1] > 2 * mean[0] and len(set(got.values())) > 1000


def test_remembered_evidence_stays_right(counted):
    model = counted[1].model()
    every = ["graghan", "theor", "x", "blurkou", "anthe"]
    evidence, want = toxicity.Evidence(model, remembered=2), model.evidence(every)
    for _ in range(3):
        assert np.allclose(evidence.of(every[:3]), want[:3]) and np.allclose(evidence.of(every[2:]), want[2:])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_toxicity(spark):
    from sparkloom.llm import queries

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    got = queries.op2_toxicity(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted and not r.toxic for r in got) <= 1
    assert sum(r.predicted and r.toxic for r in got) >= 0.7 * sum(r.toxic for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    from sparkloom.llm import queries

    d = "/root/testdata/sf0.01"
    lang = queries.op5_language(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert lang.where("lang_pred = lang").count() >= 0.97 * lang.count()
