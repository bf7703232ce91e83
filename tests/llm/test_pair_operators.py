"""Near-duplicates, substrings, WARC archives and neighbours against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from pricelake.llm import ann, neardup, queries, substrings, warc
from pricelake.llm.common import lower_ascii
from tests.compare import assert_same, database

SCHEMA = "doc_id long, text string, bucket long, component long, words string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=1):
    """Copies, graded near-copies of one text, shared passages, short and blank texts, and equal ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "  ".join(base)), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, "One two"), (8, "one two three four five")]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 14)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((10 + i, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(100 + i, " ".join(word() for _ in range(30)) + " " + passage + "\n" + word()) for i in range(20)]
    rows += [(200, "again and again " * 60), (300, rows[20][1]), (300, rows[20][1]), (None, " ".join(base)), (None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "3") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = words(lower_ascii(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def assert_components(found, rows):
    """Components, sizes and kept of every row against all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    return len({find(i) for i in ids})


def test_near_duplicates(documents, rows, empty):
    assert_components(neardup.near_duplicates(documents).collect(), rows)
    assert neardup.near_duplicates(empty).count() == 0


def test_a_bucket_of_many_unlinked_members(spark, monkeypatch):
    """Edited copies of a text that is not there itself: they share buckets, few are linked, and most pairs are ruled out uncompared."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for i in range(700):
        copy = list(base)
        for k in rng.sample(range(5, 115), 3 if i % 2 else 4):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    met = []
    plain = neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda facts: met.append(plain(facts).count()) or plain(facts))
    groups = assert_components(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert groups > 100
    assert sum(met) < len(rows) * (len(rows) - 1) / 2 / 3


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    shared, left, right = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (600, 100, 100))
    a, b = np.union1d(shared, left), np.union1d(shared, right)
    sketch = neardup.registers([a, b, np.union1d(a, b)])
    assert (neardup.merged(sketch[:2]) == sketch[2]).all()
    near = neardup.estimate(sketch[:1], sketch[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(near - 0.75) < 0.12


def cut_by_windows(rows):
    """(id, words, removed, spans, digest) of each row, window by window."""
    first = {}
    for i, t in sorted(rows, key=lambda r: substrings.LAST if r[0] is None else r[0]):
        w, key = words(t), substrings.LAST if i is None else i
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            first[g] = min(first.get(g, (key, s)), (key, s))
    want = []
    for i, t in rows:
        w, key = words(t), substrings.LAST if i is None else i
        gone = {s + k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (key, s) for k in range(20)}
        spans = [s for s in sorted(gone) if s - 1 not in gone], [s + 1 for s in sorted(gone) if s + 1 not in gone]
        want.append((i, len(w), len(gone), tuple(zip(*spans, strict=True)), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(want, key=str)


def cut(documents):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], tuple(map(tuple, r["spans"])), r["kept_sha256"]) for r in substrings.removed(documents).collect()), key=str)


def test_substrings(documents, rows, empty):
    assert cut(documents) == cut_by_windows(rows)
    assert substrings.removed(empty).count() == 0


@pytest.mark.parametrize("rows_of_a_group", [20, 2])
def test_prefixes_are_lengthened_until_groups_fit(monkeypatch, documents, rows, rows_of_a_group):
    """Down to groups that even the whole window cannot split, which are merged in salted parts."""
    made = []
    plain = substrings.grouped
    monkeypatch.setattr(substrings, "GROUP_ROWS", rows_of_a_group)
    monkeypatch.setattr(substrings, "grouped", lambda *a: made.append(plain(*a)) or made[-1])
    assert cut(documents) == cut_by_windows(rows)
    groups, salts = made[0]
    assert groups.levels and (rows_of_a_group > 2 or len(groups.levels) == 3 and salts)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    twice = f"{text} {text}"
    rows = [(7, twice), (7, twice.replace(" ", "  ")), (7, text), (9, twice), (9, twice), (8, f"{text} x"), (None, twice), (None, twice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        assert cut(df.repartition(parts)) == cut_by_windows(rows)


def test_nodes_of_the_suffix_tree():
    """Every repeat that can be lengthened on no side to the right, and how often it stands, against all substrings."""
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 400)
    text[200:260] = text[20:80]
    h = np.array([substrings.xxhash.xxh64_intdigest(bytes([c])) for c in text], np.uint64)
    n = len(text) - substrings.WINDOW + 1
    s = np.zeros(n, substrings.SUFFIX)
    s["words"] = np.lib.stride_tricks.sliding_window_view((h >> np.uint64(48)).astype(np.uint16), substrings.WINDOW)
    s["full"], s["start"] = substrings.prefixes(h)[-1], np.arange(n)
    s = substrings.by_words(s[rng.permutation(n)])
    found = {(depth, tuple(sorted(s["start"][a : b + 1].tolist()))) for depth, first, last in substrings.nodes(substrings.common_lengths(s)) for a, b in zip(first, last, strict=True)}
    want = set()
    for depth in range(1, substrings.WINDOW + 1):
        places = {}
        for k in range(n):
            places.setdefault(tuple(text[k : k + depth]), []).append(k)
        for at in places.values():
            if len(at) > 1 and (depth == substrings.WINDOW or len({text[k + depth] for k in at}) > 1):
                want.add((depth, tuple(at)))
    assert found == want
    deep = [at for depth, at in want if depth == substrings.WINDOW]
    assert sorted(s["start"][substrings.later(s)].tolist()) == sorted(k for at in deep for k in at[1:])


def page_rows():
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + "ü" * 900 + "</p>"
    return [(1, "http://a\r\nX: y", "<p>hi</p>"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", big), (6, "u", big), (7, "u", f"<pre>{fake}</pre>"), (8, "u", fake * 3), (9, "u", "WARC/1.0\r\n"), (10, "u", "a" * 999), (11, "u", "a" * 999), (12, "u", fake * 20), (13, "u", "tail\r\n\r\n"), (6, "u", big), (None, "u", big)]


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(2)
    latest = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= 1000:
            latest[h] = max(latest.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        top = latest.get(h)
        old = top is not None and i is not None and i < top
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if old else "response", top if old else None))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warc.round_trip(pages.where("false")).count() == 0


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4:
            good[i] = np.array(v)
    out = {}
    for q in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
    return out


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(700, None), (701, [0.0] * 4), (702, [1.0, None, 1.0, 1.0]), (703, [float("nan")] * 4), (800, [float("inf"), 0.0, 0.0, 0.0]), (900, [1.0, 2.0]), (None, [1.0] * 4), rows[5]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 10)
    assert set(found) == set(want)
    for q, hits in found.items():
        assert [i for _, i, _ in sorted(hits)] == [i for _, i in want[q]]
        assert np.allclose([s for _, _, s in sorted(hits)], [s for s, _ in want[q]], atol=1e-12)
    assert ann.neighbours(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def recall(spark, x, **options):
    """Share of the ten nearest that are found, over all queries; what is found must carry its exact distance."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, **options).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    x, hit = x.astype(float), 0
    assert set(got) == set(range(0, len(x), 100))
    for q, found in got.items():
        assert len(found) == 10
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(found) & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
        assert np.allclose(list(found.values()), d[list(found)], atol=1e-12)
    return hit / (10 * len(got))


def visited(x, queries):
    """Share of the table in the leaves that a query opens, on average."""
    x = x.astype(float)
    sample = x[np.random.default_rng(0).permutation(len(x))[: ann.SAMPLE]]
    forest = ann.grown(sample, len(x))
    leaves, radius, share = [t.leaves(x) for t in forest], ann.radii(x[queries], sample, 11), []
    for q, r in zip(queries, radius, strict=True):
        seen = np.zeros(len(x), bool)
        for k, leaf in ann.search(forest, x[q], (ann.REACH * r) ** 2 / x.shape[1]):
            seen |= leaves[k] == leaf
        share.append(seen.mean())
    return float(np.mean(share))


def test_neighbour_recall_on_the_table(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    x = np.stack(spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()["embedding"])
    assert recall(spark, x) >= 0.9


def test_neighbour_recall_where_few_leaves_are_visited(spark):
    """50,000 clustered vectors with production parameters: under a tenth of the table is visited."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(50_000, 32)) + 6 * rng.normal(size=(400, 32))[rng.integers(0, 400, 50_000)]).astype(np.float32)
    assert visited(x, list(range(0, 50_000, 500))) < 0.1
    assert recall(spark, x) >= 0.9


@pytest.mark.parametrize(("n", "leaf"), [(3000, 64), (20_000, 256)])
def test_neighbour_recall_without_structure(spark, n, leaf):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    assert recall(spark, x, leaf=leaf) >= 0.9


def test_buckets_are_sliced_for_many_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 5)
    x = np.random.default_rng(6).normal(size=(3000, 8)).astype(np.float32)
    assert recall(spark, x, leaf=32) >= 0.9


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), database(sf_dir), queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from pricelake.llm import packing, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "predicted")
    out = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, sf_dir)
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert name == "packing" or out.columns == before.columns
    assert kept["near_duplicates"] <= kept["toxicity"] and kept["secrets"] == kept["near_duplicates"]
    net = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept["toxicity"] == {r["doc_id"] for r in toxicity.scored(docs, net).where("score < 0.5").collect()}
    total = out.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= packing.LENGTH
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_keeps_null_ids_beside_repeated_ids(spark, sf_dir):
    import corpus_pipeline

    text = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=80))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, None), (4, text(4)), (5, text(5)), (5, text(6)), (5, text(6)), (6, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    outs = [corpus_pipeline.near_duplicates_stage(spark, docs.repartition(n, "text"), sf_dir) for n in (1, 7)]
    assert outs[0].columns == docs.columns
    first, second = (sorted(map(str, out.collect())) for out in outs)
    assert first == second
    ids = [r["doc_id"] for r in outs[0].collect()]
    assert ids.count(None) == 4 and sorted(i for i in ids if i is not None) == [4, 5, 6]
