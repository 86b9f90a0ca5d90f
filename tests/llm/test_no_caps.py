"""Results that neither a cap nor the number of partitions may change."""

import random

import pyarrow as pa
import pytest

from terrachron.llm import hmm, packing, substrings

FOLDER = "/root/testdata/sf0.001"


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one, four = ({r.doc_id: r for r in hmm.language_scores(docs.repartition(n, "doc_id")).collect()} for n in (1, 4))
    assert one.keys() == four.keys()
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (four[i].n_tokens, four[i].n_known, four[i].train_tokens)
        assert r.base_score == pytest.approx(four[i].base_score, rel=1e-9) and r.score == pytest.approx(four[i].score, rel=1e-6)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def letters(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


def test_chunks_resist_shifts_without_white_space():
    text = letters(random.Random(1), 4000)
    sets = []
    for t in (text, "字" + text, letters(random.Random(2), 700) + text):
        data = t.encode()
        ends = substrings.cuts(data, 4)
        assert ends[-1] == len(data) and all(b"".join([data[a:b]]).decode() is not None for a, b in zip([0, *ends], ends, strict=False))
        sets.append({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(sets[0]) > 80
    assert len(sets[0] - sets[1]) <= 2 and len(sets[0] - sets[2]) <= 3


def test_words_are_cut_as_before():
    rng = random.Random(3)
    text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "consectetur"]) for _ in range(2000)).encode()
    assert all(text[e - 1 : e] == b" " for e in substrings.cuts(text, 4)[:-1])


def test_repeated_passages_without_white_space_go(spark):
    rng = random.Random(4)
    passage = letters(rng, 300)
    rows = [(i, letters(rng, 200) + passage + letters(rng, 200)) for i in range(4)] + [(9, letters(rng, 500)), (10, "короткий текст")]
    got = {r.doc_id: r for r in substrings.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[9].n_removed == got[10].n_removed == 0
    for i in (1, 2, 3):
        assert 0.7 * 900 <= got[i].n_removed <= 900
        a, b = got[i].spans[:2]
        assert 600 <= a and b <= 1500


def test_special_tokens_are_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b <|endoftext", "plain"]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        assert {r.doc_tokens for r in got if r.doc_id == i} == {len(tokenizer.encode(t, add_special_tokens=False).ids) + 1}


def test_a_packing_task_leaves_no_second_memory(monkeypatch):
    """A worker kept up to twice REMEMBERED words after its task, beside what the next stage needs."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 0}))
    encode = packing.tokenizer("byte_bpe_50k.json", False)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [" ".join(f"name{i}" for i in range(100 * k, 100 * k + 100))]}) for k in range(4)]
    assert sum(b.num_rows for b in packing._pack("byte_bpe_50k.json", False, 1, 2048)(iter(batches))) >= 4
    assert encode.known and not encode.older
