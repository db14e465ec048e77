"""Language ID, SimHash, decontamination, piece ids and the pipeline against brute force."""

import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import decontaminate as D
from quantloom.llm import langid
from quantloom.llm import queries as Q
from quantloom.llm.simhash import components, links, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# language ID


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = Q.op4_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    right = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(right) / len(right) >= 0.95


def test_language_odd(spark, odd_docs):
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in (("the cat and dog", "aa"), ("le chat et chien", "bb"))], "doc_id long, text string, lang string"))
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), model).count() == 0


# SimHash


def _fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    """doc -> smallest doc reachable, by all pairs."""
    of = {i: i for i in fps}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(fps, 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((root(i), root(j)))
            of[b] = a
    return {i: root(i) for i in fps}


def test_simhash_whole_table(spark, sf_dir):
    fps = {r["doc_id"]: _fingerprint(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = _components(fps)
    for r in Q.op9_simhash_dedup(spark, sf_dir).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])


@pytest.mark.parametrize("bucket", [32, 2])
def test_links_keep_components(spark, bucket):
    """Dense neighbourhoods, so that buckets overflow; labels must match all pairs."""
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["label"] for r in components(links(df, bucket)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f in signed:
        groups[found.get(f, f)].add(f)
    for f, c in _components({f: f % (1 << 64) for f in sorted(signed)}).items():
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd(spark, odd_docs):
    rows = near_duplicates(odd_docs.filter("doc_id is not null")).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 9 and by[5] == by[6] == 5 and by[1] == by[2] == by[3] == 1


def test_simhash_sends_no_variants_through_the_driver(spark):
    """Variants are 64 times as many as the table that Spark judges their size by."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(12))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 4 << 20)
    try:
        assert near_duplicates(docs).count() == 3000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


# decontamination


def test_edit_distance():
    rng = random.Random(4)
    np = D.np

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, old[j] + 1, old[j - 1] + (x != b[j - 1])), initial=i)) if (old := row) else row
        return row[-1]

    for _ in range(60):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 7))]
        window = [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        d, start, end = D.fitting_distance(np.array(item), np.array(window, int))
        best = min(full(item, window[i:j]) for i in range(len(window) + 1) for j in range(i, len(window) + 1))
        assert d == best == full(item, window[start:end])


def _edited(words, edits, rng, word):
    out = list(words)
    for _ in range(edits):
        kind, at = rng.random(), rng.randrange(len(out))
        if kind < 0.34:
            out[at] = word()
        elif kind < 0.67 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, word())
    return out


@pytest.mark.parametrize("length", [2, 4, 5, 7, 8, 12, 30, 100, 300])
def test_recall_with_all_edits(length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(length))) for i in range(40)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 200))] + _edited(t.split(), D.allowed(length, 0.8), rng, word) + [word() for _ in range(50)]) for _, t in items]
    found = {(k, i) for k, i, *_ in D.Items.build(items, 0.8, D.TABLES, D.SAMPLED).search(texts)}
    assert len(found & {(i, i) for i, _ in items}) >= 0.95 * len(items)
    assert not any(i for _, i, *_ in D.Items.build(items, 0.8, D.TABLES, D.SAMPLED).search([" ".join(word() for _ in range(500))]) if length > 4)


def test_blocks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(40)]
    docs = [(n, " ".join([word() for _ in range(100)] + items[n % 40][1].split() + [word() for _ in range(50)])) for n in range(80)]
    for block in (D.BLOCK, 1500):
        found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(n, n % 40) for n in range(80)}
        assert all((r["distance"], r["start"], r["end"]) == (0, 100, 100 + len(items[r["item_id"]][1].split())) for r in found)


def test_all_windows_brute_force(spark, sf_dir):
    """Every text of sf0.001 against every item, by edit distance over the whole text."""
    np = D.np
    items = [(r["item_id"], D.words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    number = {}
    coded = [(i, np.array([number.setdefault(w, len(number) + 1) for w in words])) for i, words in items]
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = np.array([number.get(w, 0) for w in D.words_of(r["text"])], int)
        want |= {(r["doc_id"], i) for i, item in coded if len(text) and np.isin(item, text).sum() >= 0.8 * len(item) and D._last_row(item, text, True).min() <= D.allowed(len(item), 0.8)}
    found = {(r["doc_id"], r["item_id"]) for r in Q.op8_decontamination(spark, sf_dir).collect()}
    assert want and found <= want and len(found) >= 0.95 * len(want)


def test_every_exact_leak(spark, sf_dir):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, t in items.items() if t in (r["text"] or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in Q.op8_decontamination(spark, sf_dir).collect()}


def test_decontamination_odd(spark, odd_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (4, "word " * 20), (4, "word " * 20)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(odd_docs, items).collect()}
    assert found == {(7, 4), (5, 3), (6, 3)}
    left = D.drop_leaking(odd_docs.withColumn("leak_", F.lit(1)), items)
    assert left.columns == [*odd_docs.columns, "leak_"]
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "8", "None"]
    rows = spark.createDataFrame([(None, "so same text here it is"), (None, "no id"), (1, "no id")], "doc_id long, text string")
    assert D.drop_leaking(rows, items).count() == 2 and D.find_leaks(rows, items).first()["doc_id"] is None
    assert D.find_leaks(odd_docs.limit(0), items).count() == 0 == D.find_leaks(odd_docs, items.limit(0)).count()


# pipeline


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    out = pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert out.count() == before.count() and out.filter(~F.col("round_trip")).count() == 0
    leaks = {r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert not any(t in (r["text"] or "") for r in before.collect() for t in leaks)
