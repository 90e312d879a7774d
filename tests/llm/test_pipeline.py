import hashlib
import random
from collections import Counter

import corpus_pipeline
from strataq.llm import bpe, secrets
from tests.llm.test_quality import brute


def write(spark, docs_of, rows, folder):
    df = docs_of(rows, extra=())
    from pyspark.sql import functions as F

    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    rows, group = [], {}
    for i in range(80):
        w = [word() for _ in range(rnd.choice([150, 400]))]
        for c in range(rnd.choice([1, 1, 2, 3])):
            v = list(w)
            if c == 2:
                v[len(v) // 2] = "edited"
            group[len(rows)] = i
            rows.append((len(rows), " ".join(v) + ("\npassword = hunter2hunter2" if i % 9 == 0 else ""), rnd.choice(["a", "a", "b", None])))
    for t in ("", None, "too short", "again " * 50):
        group[len(rows)] = -len(rows)
        rows.append((len(rows), t, "a"))
    return rows, group


def test_stages_against_brute_force(spark, docs_of, tmp_path):
    rows, group = corpus()
    write(spark, docs_of, rows, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {d for (d, _, _, _, k), n in brute(rows, 20).items() if k}
    a = corpus_pipeline.near_dedup  # stages in order, each on all that the one before kept
    q = corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).cache()
    assert q.columns == columns and {r.doc_id for r in q.collect()} == kept
    assert {r.doc_id: r.text for r in q.collect()} == {d: t for d, t, _ in rows if d in kept}  # nothing clean is changed
    n = a(spark, q, str(tmp_path)).cache()
    first = {}
    for d in sorted(kept):
        first.setdefault(group[d], d)
    assert n.columns == columns and {r.doc_id for r in n.collect()} == set(first.values())
    s = corpus_pipeline.secret_scan(spark, n, str(tmp_path)).cache()
    texts = {r.doc_id: r.text for r in s.collect()}
    raw = {r.doc_id: r.text for r in n.collect()}
    assert s.columns == columns and all("hunter2" not in t for t in texts.values()) and texts.keys() == raw.keys()
    assert all(texts[d] == raw[d] for d in raw if not secrets.scan_batch([raw[d].encode()])[0])
    m = corpus_pipeline.source_mix(spark, s, str(tmp_path)).cache()
    out = m.collect()
    total = sum(len(t.split()) for t in texts.values())
    assert m.columns == columns and abs(sum(len(r.text.split()) for r in out) - 1.5 * total) <= 0.03 * total
    assert max(Counter(r.doc_id for r in out).values()) == 2 and all(r.n_chars == len(r.text) for r in out)
    t = bpe.load(bpe.path("word_bpe_49k.json"))
    want = Counter()
    for r in out:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == want


def test_empty_table(spark, docs_of, tmp_path):
    write(spark, docs_of, [(1, "x", "a")], tmp_path)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
