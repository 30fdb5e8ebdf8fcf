"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from rubrica.llm import transducer

from .test_llm_operators import SPACE_WORDS, components, contaminated

WORDS = (
    "window river garden morning letter winter people number mountain village summer teacher market winter bridge forest kitchen doctor history weather "
    "station picture company evening country question machine language journey building harbour library engine college island police meeting festival"
).split()
KEYS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows():
    rng = np.random.default_rng(0)
    out = [(i, text(i)) for i in range(30)]
    out += [(100 + i, text(i)) for i in range(4)]  # exact copies
    out += [(200 + i, " ".join([*text(i).split()[:59], "changed"])) for i in range(4, 8)]  # near copies
    out += [(300, text(300, 12)), (301, " ".join(text(301, 9).split() * 9)), (302, None), (303, "")]
    out += [(400 + i, f"{text(400 + i, 25)} {BENCH} {text(500 + i, 25)}") for i in range(3)]
    out += [(600 + i, f"{text(600 + i, 30)} AKIA{''.join(rng.choice(KEYS, 16))} {text(700 + i, 30)}") for i in range(12)]
    out += [(800 + i, f"{text(800 + i, 30)} {'windowrivergardenmorning'[: 16 + i % 8]} {text(900 + i, 30)}") for i in range(12)]
    return out


BENCH = " ".join(np.random.default_rng(77).choice(WORDS, 14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH.upper()), (2, "not in any document of this corpus at all, never ever")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def survivors():
    def repeated(words):
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        return {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}

    good = [(i, t) for i, t in rows() if len(w := SPACE_WORDS.findall(t or "")) >= 20 and 100 * len(repeated(w)) <= 30 * len(w)]
    single = {i for i, _, c in components(good, 5, 80) if i == c}
    good = [(i, t) for i, t in good if i in single]
    clean = {i for i, _, n, _ in contaminated(good, [(1, BENCH)]) if not n}
    return {i: " ".join("[SECRET]" if w.startswith("AKIA") else w for w in t.split(" ")) for i, t in good if i in clean}


def test_pipeline(spark, folder):
    want = survivors()
    assert len(want) == 30 + 24 and 301 not in want
    got = corpus_pipeline.run(spark, folder)
    out = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in out.values())
    machine = transducer.Transducer(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for i, r in out.items():
        assert machine.decode(np.array(r.ids, np.int64), np.array([0, len(r.ids)])) == [want[i]]


def test_stages(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).collect() == []
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []
