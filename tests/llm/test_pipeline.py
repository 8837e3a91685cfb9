"""The pipeline against a plain Python version on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def build(rng):
    items = [(i, prose(rng, 25)) for i in range(3)]
    rows = []
    for i in range(60):
        text = f"{prose(rng, 30)}\nRead more on page {i}\n{prose(rng, 40)}"
        if i % 10 == 3:
            text = "too few words"
        if i % 10 == 4:
            text = "the same five words again " * 12
        if i % 10 == 5:
            text = f"{prose(rng, 20)} {items[i % 3][1]} {prose(rng, 20)}"
        if i % 10 == 6:
            text = rows[i - 5][1]
        if i % 10 == 7:
            w = rows[i - 6][1].split(" ")
            text = " ".join([*w[:-1], "changed"])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return rows, items


def quality(rows):
    texts, seen = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower().strip(" ")))
    for _, text, _, host, _ in rows:
        texts[host].add(text)
        for line in text.split("\n"):
            seen[host, norm(line)].add(text)
    out = []
    for doc_id, text, lang, host, _ in rows:
        w = WORD.findall(text)
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        rest = "\n".join(x for x in text.split("\n") if not WORD.search(x) or not (len(seen[host, norm(x)]) > 10 and len(seen[host, norm(x)]) > 0.05 * len(texts[host])))
        left = len(WORD.findall(rest))
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and left >= 10 and left >= 0.5 * len(w):
            out.append((doc_id, rest, lang, host))
    return out


def dedupe(rows):
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [WORD.findall(r[1].lower())] for i in range(len(w) - 4)} for r in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return [r for r in rows if label[r[0]] == r[0]]


def mix(rows):
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    hosts = sorted({r[3] for r in rows})
    total = {h: sum(size[r[0]] for r in rows if r[3] == h) for h in hosts}
    weight, capped = {h: (5, 2, 1)[i % 3] for i, h in enumerate(hosts)}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[h] for h in capped)
        target = {h: 2 * total[h] if h in capped else left * weight[h] / sum(weight[x] for x in hosts if x not in capped) for h in hosts}
        over = {h for h in hosts if h not in capped and target[h] > 2 * total[h]}
        if not over:
            break
        capped |= over
    out = []
    for h in hosts:
        budget = round(target[h])
        whole, rest = divmod(budget, total[h])
        for r in sorted((r for r in rows if r[3] == h), key=lambda r: int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:15], 16)):
            out += [(r[0], r[1])] * whole
            part = min(rest, size[r[0]])
            rest -= part
            if part == size[r[0]]:
                out.append((r[0], r[1]))
            elif part:
                out.append((r[0], " ".join(WORD.findall(r[1])[:part])))
    return out


def test_pipeline_is_the_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = build(random.Random(21))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = Tokenizer.from_file(corpus_pipeline.tokenizer_file(corpus_pipeline.TOKENIZER))
    kept = dedupe(quality(rows))
    clean = [r for r in kept if not any(text in r[1] for _, text in items)]
    assert len(rows) > len(kept) > len(clean) > 0
    want = Counter()
    for doc_id, text in mix(clean):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, corpus_pipeline.END_ID], dtype="<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
