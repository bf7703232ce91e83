"""Source divergence, benchmark search and collocations against plain loops on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from pricelake.llm import collocations, decontamination, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, rank int, spans string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one, TWO three"), (3, "solo9"), (4, None), (5, " ... "), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (None, "four five six"), (10, "one two three"), (7, "x x x x x x x x x x x"),
]


def random_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma,", "delta", "(one", "two", "three)", "Three", "solo9", "x", "é", "Éa-b", "four", "five\nsix", "a\tb", "tail.", "\x85", " y "]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \t", "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "x " * 12, "one two " * 3 + "three", "four! five? six", *random_texts(60, 3), "pad " * 20000 + "one two three"]
    out = [(i, t, ("en", "de", None, "")[i % 4], ("s0", "s1", None)[i % 3], "c", 1, "d") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "solo9 x", "en", "s9", None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_hits(text):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, items = find(text), set(), set()
    for item, passage in BENCH:
        w = find(passage)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    items.add(item)
    items = sorted(str(x) for x in items if x is not None)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [1000, 2])
def test_benchmark_passages(spark, documents, rows, most):
    """At once, and in slices of a few windows."""
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.contaminated(documents, bench, most=most).collect()
    key = lambda i, facts: (i is None, i or 0, facts)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(key(r["doc_id"], tuple(r[c] for c in columns)) for r in got) == sorted(key(r[0], plain_hits(r[1])) for r in rows)


def test_benchmark_empty_tables(spark, documents, empty, rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(documents, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.scanned(documents, bench, carry=["lang", "source"]).count() == len(rows)


def test_shift_tables_skip_and_miss_nothing():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        found = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)}
        got = sorted((end, w) for p in decontamination.prepared([(" ".join(w), "i") for w in found]) for end, w in p.ends(words))
        assert got == sorted((i + len(w), w) for w in found for i in range(len(words) - len(w) + 1) if tuple(words[i : i + len(w)]) == w)


def plain_divergence(rows, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, inside, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in term.findall(text or "")]
        sources[lang].add(source)
        counts[lang, source].update(terms)
        inside[lang].update(set(terms))
    out = set()
    value = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, names in sources.items():
        kept = [t for t, n in inside[lang].items() if n >= least]

        def chances(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}

        p = {s: chances(counts[lang, s]) for s in names}
        q = chances(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(-value(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least", [10, 3, 10_000])
def test_divergence(documents, rows, least):
    got = [tuple(r) for r in divergence.audited(documents, least).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, least)


def test_divergence_counts_documents_not_chunks(spark):
    """Ten chunks of one term: in ten documents in all, but two of them share one."""
    chunks = ["word", "word,", "word.", "(word", "word)", "word!", "word?", "word;", "'word", "word:"]
    apart = [(i, f"{c} {'z' * (i + 1)}", "en", "s", None, None, None) for i, c in enumerate(chunks)]
    together = [*apart[:8], (8, "'word word:", "en", "s", None, None, None)]
    for rows, terms in ((apart, {"word"}), (together, set())):
        groups, counts = divergence.measured(spark.createDataFrame(rows, SCHEMA))
        assert {r["term"] for r in counts.collect()} == terms
        assert groups.first()["n_terms"] == len(terms)


def test_divergence_of_an_empty_table(empty):
    assert divergence.audited(empty).count() == 0


def plain_phrases(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in candidates.items():
            if any(100 * b >= 50 * a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), left, right))
        out |= {(lang, k, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for k, x in enumerate(sorted(kept)[:top], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"most_words": 0, "most_phrases": 0}, {"least": 2}, {"least": 3, "top": 5}])
def test_collocations(documents, rows, options):
    """With semi-joins inside the pass, by shuffles, and with other bounds."""
    got = [tuple(r) for r in collocations.collocations(documents, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_phrases(rows, options.get("least", 10), options.get("top", 2000))


def test_collocations_of_an_empty_table(empty):
    assert collocations.collocations(empty).count() == 0
