"""Chat, line dedup, sharding, personal data, quality, licenses against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat, licenses, quality
from quantloom.llm import queries as Q
from quantloom.llm.chat_digest import read_back
from quantloom.llm.line_dedup import drop_boilerplate_lines
from quantloom.llm.pii import find_personal_data
from quantloom.llm.sharding import assign_slots, rendezvous_shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# chat


def _digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: tuple(r)[1:5] for r in Q.op1_chat_format(spark, sf_dir).collect()}
    assert found == _digests(rows)


@pytest.mark.parametrize("budget,history", [(20, 0), (40, 15), (512, 128), (1, 1)])
def test_chat_windows(spark, budget, history):
    rng = random.Random(budget)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "a b", "", "\n", "😀", "<\\s>"]
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(12) for t in range(rng.randint(1, 30))]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history, chunk_turns=8)
    for w in windows.collect():
        assert w["n_tokens"] <= budget or w["over_budget"]
        parsed = chat.parse_window(w["formatted"])
        spans = {(s["start"], s["end"]) for s in w["loss_spans"]}
        assert spans == {(a, b) for i, (r, _, a, b) in enumerate(parsed) if i >= w["n_repeated"] and r == "assistant"}
    found = {r["conv_id"]: tuple(r)[1:5] for r in read_back(windows).collect()}
    assert found == _digests(rows)


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", None), (None, None, None, "x"), (3, 2, "assistant", "a"), (3, 2, "assistant", "a"), (3, 2, "user", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk long")
    found = {r["conv_id"]: r["n_turns"] for r in read_back(chat.format_conversations(df)).collect()}
    assert found == {None: 2, 3: 3}
    assert chat.format_conversations(df.limit(0)).count() == 0


# line dedup


def _boilerplate(rows, ratio):
    pages, lines = Counter(), Counter()
    for _, text, host in rows:
        if host is not None:
            pages[host] += 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                lines[host, line] += 1
    bad = {k for k, n in lines.items() if n > 1 and n > ratio * pages[k[0]]}
    return Counter(
        (i, text if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") == "" or (host, x.strip(" ")) not in bad)) for i, text, host in rows
    )


@pytest.mark.parametrize("most", [200_000, 0])
def test_line_dedup(spark, most):
    rng = random.Random(3)
    pool = ["menu", " menu ", "", "foot", "rare one", "x" * 500, "é"]
    rows = [(i, rng.choice([None, "", "\n".join(rng.choices(pool + [f"own {i}"], k=rng.randint(1, 6)))]), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, keys_ long")
    out = drop_boilerplate_lines(df, F.col("source"), ratio=0.2, broadcast_keys=most)
    assert out.columns == [*df.columns, "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == _boilerplate(rows, 0.2)
    assert drop_boilerplate_lines(df.limit(0), F.col("source")).count() == 0
    kept = drop_boilerplate_lines(df.withColumn("n_dropped", F.lit(77)), F.col("source"), dropped_col=None)
    assert {r["n_dropped"] for r in kept.collect()} == {77}
    two = spark.createDataFrame([(1, "a\nb", "small"), (2, "a\nc", "small"), (3, "d", "one")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in drop_boilerplate_lines(two, F.col("source")).collect()} == {1: "b", 2: "c", 3: "d"}


# sharding


def test_sharding_law(spark, sf_dir):
    rows = Q.op3_rendezvous_shard(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards(spark):
    df = spark.range(20_000).select("id", rendezvous_shard(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("s"))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert 2 not in n and abs(n[1] / 20_000 - 0.5) < 0.02
    odd = spark.createDataFrame([(None, 1), (None, 1), (4, 2)], "k long, n long").withColumn("s", rendezvous_shard(F.col("k"), [1.0]))
    assert sorted(r["slot"] for r in assign_slots(odd, "s", "k").collect()) == [0, 1, 2]


# personal data


def _base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def _check_base(found, texts):
    for r in found:
        want = _base_spans(texts[r["doc_id"]] or "")
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}


def test_personal_data_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    _check_base(Q.op5_personal_data(spark, sf_dir).collect(), texts)


def test_personal_data_made_up(spark, tmp_path):
    rng = random.Random(5)
    alphabet = ["a", "@", ".", "-", "1", "255", "256", " ", "+", "(", "4111111111111111", "4111 1111 1111 1111", "é😀", "\n", "\t", "x@y.z", "_", "0", "10.0.0.1", "+49 (30) 123456"]
    texts = {i: "".join(rng.choices(alphabet, k=rng.randint(0, 40))) for i in range(600)}
    texts |= {600: None, 601: "1" * 50_000, 602: "a." * 30_000 + "@", 603: "+1" + " 2" * 20_000, 604: "1." * 30_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _check_base(Q.op5_personal_data(spark, str(tmp_path)).collect(), texts)


def test_many_matches_take_linear_time(spark):
    import time

    rows = spark.createDataFrame([(1, "10.0.0.1 " * 32_000)], "doc_id long, text string")
    began = time.time()
    spans = find_personal_data(rows).first()["spans"]
    assert len(spans) == 32_000 and spans[-1]["end"] == 32_000 * 9 - 1 and time.time() - began < 20


def test_added_kinds(spark):
    df = spark.createDataFrame([(1, "my iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82 WEST 1234 5698 7654 33"), (3, 'token = "' + "0af1" * 10 + '"')], "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_personal_data(df).collect()}
    assert "iban" in kinds[1] and "iban" not in kinds[2] and "secret" in kinds[3]


# quality


def _repeat(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality_base(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op7_quality(spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        w, lines = WORD.findall(t), t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, _repeat(w))
        failed = len(w) < 10 or 100 * _repeat(w) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_verdicts(spark):
    """Against the labels of the larger table: nearly all junk goes, clean texts stay."""
    d = "/root/testdata/sf0.01"
    n = Counter((r["quality"], r["kept"], r["base_failed"]) for r in Q.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect())
    assert n[1, False, False] <= 0.01 * (n[1, True, False] + 1)
    assert n[0, True, False] <= 0.1 * sum(v for k, v in n.items() if k[0] == 0)


def test_quality_odd(spark, odd_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert quality.judge(odd_docs.limit(0)).count() == 0


def test_label_model_finds_accuracies():
    rng = random.Random(1)
    patterns = Counter()
    for _ in range(5000):
        good = rng.random() < 0.6
        votes = [(2 if good else 0) if rng.random() < p else (0 if good else 2) for p in (0.95, 0.9, 0.9, 0.7, 0.8, 0.85)]
        patterns["".join(map(str, votes)) + "1" * (len(quality.RULES) - 6)] += 1
    got = list(quality.estimate(dict(patterns)).accuracy.values())[:6]
    assert all(abs(a - b) < 0.05 for a, b in zip(got, (0.95, 0.9, 0.9, 0.7, 0.8, 0.85)))


# licenses


def test_longest_increasing():
    rng = random.Random(2)
    for _ in range(200):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        got = licenses.longest_increasing(v)
        best = [0] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0)
        assert all(v[a] < v[b] for a, b in zip(got, got[1:]))


def test_license_finds(spark):
    notice = licenses.TEMPLATES["MIT-notice"]
    words = notice.split(" ")
    worn = " ".join(w for i, w in enumerate(words) if i % 9)
    rows = [(1, "x " * 300 + notice + " y" * 300), (2, worn), (3, " ".join(words[:20])), (4, "Released under the MIT License. And again. Released under the MIT License."), (5, None), (6, "the license of words")]
    found = defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].append((r["license"], r["start"], r["end"]))
    assert [f[0] for f in found[1]] == ["MIT-notice"] and found[1][0][1] == 300
    assert [f[0] for f in found[2]] == ["MIT-notice"]
    assert [f[0] for f in found[4]] == ["MIT", "MIT"]
    assert 3 not in found and 5 not in found and 6 not in found


def test_license_every_line(spark, sf_dir):
    found = {r["doc_id"] for r in Q.op6_license_scan(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name, line in licenses.TEMPLATES.items():
        assert {d for d, t in texts.items() if line in t} <= found, name


def test_license_odd(spark, odd_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
