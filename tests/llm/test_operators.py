"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import chat, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality, secrets, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = ["the", "of", "und", "été", "niño", "re", "sh", *(f"w{i}" for i in range(300))]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60)
BASE = prose(200)


def _copy(text, edits):
    w = text.split()
    for _ in range(edits):
        w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
    return " ".join(w)


TEXTS = [
    None, "", "  ", "one", "Two words", prose(12), BASE, BASE, BASE.upper(), *[_copy(BASE, e) for e in (1, 2, 3, 5, 8, 13, 20)], prose(40) + " " + PASSAGE + " " + prose(30), PASSAGE,
    "x " + PASSAGE + "\n" + prose(50), prose(3000), "ab " * 200, "ÀÉ é​ 日本 語", 'token = "24be64439e3e49cf46b2d7c9" AKIA' + "Z" * 16, "password: token: abcdefghijklmnop", prose(36), None, "",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1"][i % 2], 0) for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, BASE, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[20:40]).upper()), (3, "two words"), (4, None), (5, "..."), (6, prose(20)), (10, PASSAGE), (11, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_duplicates(spark, docs, empty):
    got = exact_dedup.exact_duplicates(docs, keep="largest").collect()
    groups = Counter(lower(r["text"]) for r in docs.collect())
    best = {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    by = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    assert len(got) == docs.count()
    for r in got:
        text = by[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (best[text], groups[text]) and r["kept"] == (r["doc_id"] == best[text])
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_of_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same TEXT").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_duplicates(rows).groupBy("group_size").agg(F.count("*").alias("n"), F.min("keep_id").alias("k"), F.count_if("kept").alias("kept")).collect()
    assert {(r["group_size"], r["n"], r["kept"]) for r in got} == {(1000, 1000, 1), (1, 2000, 2000)}


def test_sharding(spark, docs, empty):
    got = sharding.shard(docs, [1.0, 1.0, 2.0]).collect()
    assert len(got) == docs.count()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {i: t for i, t in enumerate(TEXTS)}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] is not None)
    # Against the definition: the least -ln(u) / weight, u from the first 52 bits of md5('key:shard').
    unit = lambda k, s: (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    for r in got:
        k = "" if r["doc_id"] is None else r["doc_id"]
        for weights, shard in (([1, 1, 2], r["shard"]), ([1, 1, 2, 4 / 3], r["grown_shard"])):
            assert shard == min(range(len(weights)), key=lambda s, w=weights, k=k: -math.log(unit(k, s)) / w[s])
    many = sharding.shard(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), [1.0, 1.0, 2.0]).groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 5000, 1) for r in many} == {0: 1.0, 1: 1.0, 2: 2.0}
    assert sharding.shard(empty, [1.0]).count() == 0


def test_secrets(spark, docs, empty):
    assert secrets.find_secrets("password: token: abcdefghijklmnop") == []
    found = secrets.find_secrets('é token = "24be64439e3e49cf46b2d7c9" AKIA' + "Z" * 16)
    assert found == [("assign", 2, 35), ("hex", 11, 35), ("access", 37, 57)]
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text", "lang")
    located, ledger = secrets.scan_history(versions)
    assert located.count() == docs.count() and ledger.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again, longer = secrets.scan_history(versions, ledger)
    assert sorted(map(str, again.collect())) == sorted(map(str, located.collect())) and longer.count() == ledger.count()
    assert secrets.scan_history(versions.limit(0))[0].count() == 0
    twice, _ = secrets.scan_history(versions, ledger.union(ledger))
    assert twice.count() == versions.count()


def test_decontamination(spark, docs, benchmark, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for r in benchmark.collect():
        w = words(r["text"])
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(r["item_id"]))
    expected = []
    for r in docs.collect():
        w, hit, items = words(r["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        expected.append((r["doc_id"], len(w), len(hit), ",".join(sorted(items)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(docs, benchmark).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got))) == sorted(map(str, expected))
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0
    clash = docs.select("*", F.lit(1).alias("h"), F.lit(2).alias("W"))
    assert decontaminate.decontaminated(clash, benchmark).columns == clash.columns
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity_matches(docs, benchmark).collect()}
    assert {(r["doc_id"], int(i)) for r in got if r["doc_id"] is not None for i in r["items"]} <= near


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(empty).count() == 0
    cells = spark.createDataFrame([(s, x, t, 10 + 7 * i) for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in "cd" for t in "ef")], "source string, lang string, topic string, tokens long")
    targets = {c: spark.createDataFrame(v, f"{c} string, target double") for c, v in {"source": [("a", 0.3), ("b", 0.7)], "lang": [("c", 0.6), ("d", 0.4)], "topic": [("e", 0.5), ("f", 0.5)]}.items()}
    raked = mixing.rake(cells, targets)
    for c, t in targets.items():
        sums = {r[c]: r["w"] for r in raked.groupBy(c).agg(F.sum("weight").alias("w")).collect()}
        assert all(math.isclose(sums[r[c]], r["target"], abs_tol=1e-6) for r in t.collect())
    spent = mixing.calibrate(raked, 0.5).agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0]
    assert math.isclose(spent, 0.5 * cells.agg(F.sum("tokens")).first()[0], rel_tol=1e-6)


def test_substrings(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    for width in (35, 20):
        seen = Counter(tuple(w[i : i + width]) for _, w in rows for i in range(len(w) - width + 1))
        expected = []
        for doc, w in rows:
            gone = set()
            for i in range(len(w) - width + 1):
                if seen[tuple(w[i : i + width])] > 1:
                    gone |= set(range(i, i + width))
            expected.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        got = substring_dedup.remove_repeats(docs, width).collect()
        assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got))) == sorted(map(str, expected))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_in_small_shards(spark, docs, monkeypatch):
    plain = sorted(map(str, substring_dedup.remove_repeats(docs).collect()))
    for levels in (8, 1):
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 600)
        monkeypatch.setattr(substring_dedup, "LEVELS", levels)
        named = docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit(1).alias("h"), F.lit(2).alias("Anchor"))
        got = substring_dedup.remove_repeats(named).withColumn("doc_id", F.expr("cast(substr(doc_id, 2) as bigint)"))
        assert sorted(map(str, got.select("doc_id", "n_words", "n_removed", "kept", "spans").collect())) == plain


def test_substrings_of_alike_words(spark):
    """A Thue-Morse word and its complement collide under polynomial hashes modulo 2**64."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(34))
    rows = spark.createDataFrame([(1, f"{same} {word}"), (2, f"{same} {word.translate(str.maketrans('ab', 'ba'))}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(rows).collect()] == [0, 0]


def test_near_duplicates(spark, docs, empty):
    W = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    rows = [(i, (r["text"] or "").lower()) for i, r in enumerate(docs.collect())]
    ids = [r["doc_id"] for r in docs.collect()]
    sh = []
    for _, t in rows:
        w = W.findall(t)
        sh.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in sh for s in c)
    n = len(rows)
    weight = [{s: k * (1 + math.log((n + 1) / df[s]) / math.log(n + 1)) for s, k in c.items()} for c in sh]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            both = sum(min(v, weight[b].get(s, 0)) for s, v in weight[a].items())
            union = sum(weight[a].values()) + sum(weight[b].values()) - both
            if rows[a][1] == rows[b][1] or (union and both / union >= 0.8):
                parent[find(a)] = find(b)
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), []).append(ids[i])
    expected = sorted(str((i, min((x for x in c if x is not None), default=None), len(c))) for c in classes.values() for i in c)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in got) == expected
    kept = near_dedup.deduplicate(docs)
    assert kept.count() == len(classes) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_quality_and_language(spark, docs, empty):
    from conftest import DATA

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(big, labels).join(labels, "doc_id").where("held_out")
    right = got.where(F.col("predicted") == F.col("quality")).count()
    assert right >= 0.93 * got.count()
    found = language_id.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * found.count()
    assert DATA
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(empty, labels).count() == 0 and language_id.identify(empty).count() == 0
    rows = language_id.identify(docs, language_id.references(big)).collect()
    assert len(rows) == docs.count() and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (0, 1, 2))


def test_chat(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    odd = spark.createDataFrame([(9000, None, None, None), (9001, 0, "user", ""), (9001, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = chat.op4_chat_format(spark, "/root/testdata/sf0.01")
    lines = got.where("held_out").agg(F.sum("n_right") / F.sum("n_lines")).first()[0]
    assert lines > 0.93
    pasted = chat.raw_transcripts(turns.unionByName(odd))
    model = chat.train(pasted.select("states", chat.observe(F.split("text", "\n")).alias("obs")))
    found = chat.format_transcripts(pasted, model)
    assert found.count() == pasted.count() and found.where("conv_id = 9001").first()["canonical"] is not None
    clear = spark.createDataFrame([("User: hi\nmore\n\nAssistant: yes",), ("",), (None,)], "text string")
    rows = [r["canonical"] for r in chat.format_transcripts(clear, model).collect()]
    assert rows == ["<|user|>\nhi\nmore\n<|end|>\n<|assistant|>\nyes\n<|end|>", "", ""]
    assert chat.format_transcripts(clear.limit(0), model).count() == 0
