import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dockledger.llm import token_machine as tm
from dockledger.llm.queries import op12_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \t\n  ", "it's IT'S we're they've I'll 'd 'll 're'r'v'l'sx '' ''s '''s !'s 's's 'rr 've 'vee 'l'll '",
    "<|endoftext|>a<|startoftext|> <|endof", "a<|endoftext|>́b<|ENDOFTEXT|>", "é é É É ́ İI ſ ǅ K Å",
    "日本語のテキスト" * 40, "한국어 한글 কো", "हिन्दी में लिखा हुआ", "x" * 3000, "!?" * 900, "12 34 5a6 ²½Ⅷ",
    "a​b﻿c\x00d\x01e \x01́", "🤔🤔 👩‍👩‍👧 ok?!?", "ﬁ Σίσυφος ΣΑΣ", "\U000e0001 \U0001f600̣̀ͅ" + "́" * 200, "ᅡᆨ ￿￾",
]


@pytest.fixture(scope="module")
def machine():
    return tm.compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64, 1 << 21])
def test_blocks_of_any_size_count_as_the_library(machine, library, size):
    assert list(tm.count_tokens(ODD, *machine, size)) == library(ODD)


def test_random_texts_count_as_the_library(machine, library):
    rng = random.Random(7)
    marks = [chr(x) for x in [*range(32, 127), *range(0xA0, 0x180), *range(0x300, 0x330), *range(0x1100, 0x1120), *range(0x1161, 0x1170), *range(0x900, 0x950)]]
    marks += ["'s", "'re", "<|endoftext|>", " ", "'l"] * 8
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [x * n for x in ("a", "ha", "!", ".-", "=", "zo", "ll") for n in range(1, 70)]
    assert list(tm.count_tokens(texts, *machine)) == library(texts)
    assert list(tm.count_tokens(texts, *machine, 1000)) == library(texts)


def test_full_tables_start_anew(machine, library, monkeypatch):
    monkeypatch.setattr(tm, "KEPT", 50)
    texts = [f"word{chr(97 + i % 26)}{i} another {'xyz' * (i % 9)}" for i in range(300)]
    assert list(tm.count_tokens(texts, *machine, 200)) == library(texts)


def test_prefix_scan_equals_reading_in_order():
    rng = random.Random(9)
    for n in (1, 63, 64, 65, 1000):
        classes = tm.np.array([rng.randrange(11) for _ in range(n)], tm.np.uint8)
        for state in range(tm.STATES):
            want, at = [], state
            for c in classes:
                at = int(tm.NEXT[c, at])
                want.append(at)
            assert tm.word_states(classes, state).tolist() == want


def test_other_files_are_refused(tmp_path):
    for name in ("byte_bpe_50k.json",):
        with pytest.raises((ValueError, KeyError)):
            tm.compile_tokenizer(public_tokenizers.path(name))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not compiled"):
        tm.compile_tokenizer(str(tmp_path / "t.json"))


def test_counts_of_odd_rows(spark, odd, none, library):
    out = tm.token_counts(odd, ["doc_id", "n_words", "n_chars"], "text", PATH).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert [r.n_tokens for r in out] == library(texts)
    assert [r.n_bytes for r in out] == [len(t.encode()) for t in texts]
    assert tm.token_counts(none, ["doc_id"], "text", PATH).collect() == []
    clash = odd.selectExpr("doc_id AS N_TOKENS", "text")
    assert tm.token_counts(clash, ["N_TOKENS"], "text", PATH).columns == ["N_TOKENS", "n_bytes", "n_tokens_"]


def test_query_counts_as_the_library(spark, docs, library):
    out = {r.doc_id: r for r in op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for row, n in zip(rows, library([r.text or "" for r in rows])):
        r = out[row.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((row.text or "").encode()), n, n > 2048)
    assert list(out[0].asDict()) == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
