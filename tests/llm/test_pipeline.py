"""The pipeline's stages, each on what the one before kept, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from corpusforge.llm import secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"aa": ["tha", "ing", "er", "on", "ste"], "bb": ["que", "eau", "ou", "é", "lle"]}


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(21)
    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
        rows.append([i, " ".join(words), lang if i % 5 else None, rng.choice(["s1", "s2", None]), 0, "extra"])
    for i in range(160, 190):  # exact and near copies
        words = rows[i - 160][1].split()
        if i % 2:
            words[0] = f"changed{i}"
        rows.append([i, " ".join(words), rows[i - 160][2], "s2", 0, "extra"])
    secret = "".join(rng.choices("0123456789abcdef", k=40))
    rows[5][1] += f' token = "{secret}" end'
    rows += [[300, None, "aa", "s1", None, None], [301, "", "aa", "s1", 0, None], [302, "12345 !!!", None, None, 9, None], [rows[0][0], rows[0][1], "aa", "s1", 0, "extra"]]
    for r in rows:
        r[4] = len(r[1] or "")
    return rows


def test_pipeline(spark, tmp_path, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "mixing", "bpe"]
    df = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == df.columns
    kept = out["language_id"]
    assert len(kept) >= len(documents) - 3 - 4  # what has no letter goes, and next to nothing else
    assert not {300, 301, 302} & {r.doc_id for r in kept}
    assert all(r.lang == ("bb" if re.search("que|eau|ou|é|lle", r.text) and not re.search("tha|ing|er|on|ste", r.text.split("token")[0]) else "aa") for r in kept if r.doc_id < 160)

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(r.text.translate(LOWER)) for r in kept)]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(kept):
        least.setdefault(find(i), []).append(r.doc_id)
    assert sorted(r.doc_id for r in out["ngram_jaccard_join"]) == sorted(min(x) for x in least.values())

    before = {r.doc_id: r.text for r in out["ngram_jaccard_join"]}
    assert {r.doc_id for r in out["secret_scan"]} == set(before)
    for r in out["secret_scan"]:
        assert not secret_scan.base_spans(r.text) and r.n_chars == len(r.text)
        assert ("<|secret|>" in r.text) == (r.doc_id == 5)
        assert r.doc_id == 5 or r.text == before[r.doc_id]

    times = collections.Counter(r.doc_id for r in out["mixing"])
    assert set(times) <= set(before) and max(times.values()) <= 3
    texts = {r.doc_id: r.text for r in out["secret_scan"]}
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in out["bpe"]) == collections.Counter({(d, hashlib.sha256(texts[d].encode()).hexdigest()): n for d, n in times.items()})
