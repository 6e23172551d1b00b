"""Packing: exact token ids, gapless sequences, and few of them."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cartulary.llm import packing
from cartulary.llm.packing import WordIds, pack, plan_runs

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_whole_encoding():
    texts = ["", " ", "It's a test., of Thé́ ABC_9,x!? <|endoftext|> a<|endoftext|>b", "İstanbul ΑΣ. ﬁ ²³ 12,5 ### a²!",
             "é. é ñ,̃ ́x", "a\x1cb \x85c\xa0d e\n\tz", "A <|ENDOFTEXT|> b, <|endoftext|>, c", "don't we'll THEY'RE !! ... ,. x'", "日本語。 テスト!"]
    whole = Tokenizer.from_file(FILE)
    assert [np.frombuffer(x, "<u4").tolist() for x in WordIds(FILE).encode(texts)] == [
        whole.encode(t, add_special_tokens=False).ids for t in texts
    ]


def _differing(texts):
    whole = Tokenizer.from_file(FILE).encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, own, found in zip(texts, WordIds(FILE).encode(texts), whole) if np.frombuffer(own, "<u4").tolist() != found.ids]


def test_word_ids_after_every_letter_and_digit():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LN"]
    assert _differing([c + "," for c in letters]) == []
    assert _differing(["x क़, y", "x ड़. y", "שׁ.", "İ,"]) == []


def test_word_ids_of_random_strings(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS_AT_ONCE", 50)
    monkeypatch.setattr(packing, "_CHARACTERS_AT_ONCE", 200)
    rng = random.Random(11)
    kinds = ["ab Z9", ".,!?'-_", "éñßİΣς", "क़ड़ि शׁב", "\u0301\u0308\u200d", "日本가각ㄱ", "½²٣Ⅷ", " \t\n", "😀…—"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["word, " * 3000]
    assert _differing(texts) == []


def test_plan_holds_every_piece_once():
    rng = random.Random(1)
    for lengths in ([], [2047], [1] * 5000, [rng.randint(1, 2047) for _ in range(6000)], [1025] * 300 + [1023] * 299, [700, 683, 665] * 500):
        counts = Counter(lengths)
        runs = plan_runs(dict(counts))
        held = Counter()
        for run in runs:
            assert sum(run.lengths) <= 2048 and run.lengths
            for size in run.lengths:
                held[size] += run.count
        assert held == counts
        assert sum(r.count for r in runs) <= 1.02 * sum(lengths) / 2048 + 30 + len([x for x in lengths if x > 1024]) * 0.15


def test_pack_places_without_gaps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("alpha", "beta,", "gamma.")) for _ in range(rng.choice((0, 3, 900, 1500, 4000))))) for i in range(60)]
    rows += [(None, None), (3, rows[3][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int").repartition(5)
    found = pack(frame, FILE).collect()
    whole = Tokenizer.from_file(FILE)
    expected = Counter()
    for doc, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            expected[(doc, piece, start, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert pack(frame.limit(0), FILE).count() == 0
