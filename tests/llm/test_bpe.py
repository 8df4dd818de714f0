import os
import random

import pytest

from spanframe.llm import bpe

PATH = os.environ.get("SPANFRAME_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    encoder = bpe.Encoder(bpe.Vocabulary(PATH), memo_entries=50)
    return encoder.encode, lambda x: t.encode(x, add_special_tokens=False).ids


def test_equal_on_odd_strings(both):
    parts = ["a", "б", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "1", "²", "Ⅷ", ".", "!!", "'s", "'ll", "don't", "<|endoftext|>", "😀", "́", "\x00", "қазақ", " the", "ability"]
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert both[0](text) == both[1](text)


def test_very_long_words(both):
    for text in ("ab" * 20_000, "қ" * 20_000, "a" * 50_001, "!" * 30_000, " " * 30_000, "x\n" * 5000):
        assert both[0](text) == both[1](text)


def test_frame(spark, both):
    rows = [(1, "Сәлем  әлем", "t"), (2, None, "t"), (3, "", "t"), (None, "a", "t"), (1, "Сәлем  әлем", "t"), (5, "word " * 30_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = [(r["doc_id"], list(r["ids"])) for r in bpe.encode_texts(df, PATH).collect()]
    assert sorted(out, key=repr) == sorted([(i, both[1](t) if t else []) for i, t, _ in rows], key=repr)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0
    assert bpe.encode_texts(df, PATH).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_rank_queue_gives_ranks_in_order():
    queue, rng = bpe.RankQueue(50_000), random.Random(3)
    entries = [(rng.randrange(50_000), rng.randrange(100)) for _ in range(2000)]
    for r, p in entries:
        queue.push(r, p)
    out = []
    while (found := queue.pop()) is not None:
        out += [(found[0], p) for p in found[1]]
    assert out == sorted(entries)
