"""Alignment of two tokenizers against a plain version with another encoder and sets of offsets."""

import hashlib
import os
import random
from collections import Counter
from itertools import accumulate

import pytest
from conftest import SF

from voxsift.llm import queries, token_alignment as alignment

FIRST, SECOND = f"{alignment.FOLDER}/{alignment.FIRST}", f"{alignment.FOLDER}/{alignment.SECOND}"
SCHEMA = "doc_id long, text string, n_a string, key string, chunk string"
pytestmark = pytest.mark.skipif(not os.path.exists(FIRST), reason="no tokenizer files")


def plain(rows):
    """The contract read literally: groups by the sets of ends, all links listed, counts over all rows."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(FIRST)
    encoder.encode_special_tokens = True
    pieces, bytes_b = alignment.second_tokenizer(SECOND)
    alphabet = alignment.byte_alphabet()
    bytes_a = {n: bytes(alphabet[c] for c in t) for t, n in encoder.get_vocab().items() if all(c in alphabet for c in t)}
    found = []
    for key, text in rows:
        a = encoder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[t] for t in a) != data or b"".join(bytes_b[t] for t in b) != data:
            found.append((key, [], [], []))
            continue
        ends_a, ends_b = list(accumulate(len(bytes_a[t]) for t in a)), list(accumulate(len(bytes_b[t]) for t in b))
        cuts, groups, low = sorted(set(ends_a) & set(ends_b)), [], 0
        for cut in cuts:
            groups.append(([t for t, e in zip(a, ends_a) if low < e <= cut], [t for t, e in zip(b, ends_b) if low < e <= cut]))
            low = cut
        found.append((key, a, b, groups))
    counts = Counter()
    for *_, groups in found:
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for key, a, b, groups in found:
        linked = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((key, len(a), len(b), len(groups), len(linked), sum(counts[p] == top[p[0]] for p in linked), sum(counts[p] for p in linked), digest))
    return sorted(out, key=repr)


def values(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)


def mixed_text(seed):
    draw = random.Random(seed)
    parts = ["the", " a", "tion", "é", "中文", "🎉", "\n", "  ", "1234", "...", "<s>", "<|endoftext|>", "'ll", "ß", "\t", "x", " word", "▁" if seed % 7 == 0 else "y"]
    return "".join(draw.choice(parts) for _ in range(draw.randint(1, 60)))


@pytest.mark.parametrize("chunk_chars", [1, 300, 3_000_000])
def test_against_plain_version(spark, chunk_chars):
    texts = [mixed_text(n) for n in range(60)] + ["two  spaces", "end ", "end  ", " start", "a \n b", "x\u00a0 y", "a\u2028 b c"] + [None, "", " ", "\n", "a", "▁", "a" * 5000, "long words " * 4000, mixed_text(3)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "the end"), (None, None), (2**60 + 1, "large key")]
    frame = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    assert values(alignment.align(frame, chunk_chars=chunk_chars)) == plain(rows)


def test_irregular_groups_against_sets():
    draw = random.Random(2)
    for _ in range(2000):
        last = draw.randint(1, 80)
        x = sorted({last, *draw.choices(range(1, last + 1), k=draw.randint(0, 60))})
        y = sorted({last, *(x if draw.random() < 0.5 else []), *draw.choices(range(1, last + 1), k=draw.randint(0, 40))})
        cuts, want, low = sorted(set(x) & set(y)), [], (0, 0)
        for cut in cuts:
            high = (x.index(cut) + 1, y.index(cut) + 1)
            if (high[0] - low[0], high[1] - low[1]) != (1, 1):
                want.append((low[0], high[0], low[1], high[1]))
            low = high
        assert alignment.irregular_groups(x, y) == want


def test_wide_groups_are_counted_by_id(monkeypatch):
    import numpy as np

    a, b = np.arange(90) % 7, np.arange(80) % 5
    groups = [(3, 60, 3, 50), (70, 72, 60, 63)]
    a, b = a[:85], b[: 3 + 47 + 10 + 3 + 13]  # the rest one to one

    def counted():
        where, codes, times = alignment.links(a, b, groups)
        total = Counter()
        for code, n in zip(codes.tolist(), times.tolist()):
            total[code] += n
        return total, len(where)

    usual = counted()
    monkeypatch.setattr(alignment, "WIDE", 4)
    assert usual[0] == counted()[0] and usual[1] > counted()[1]


def test_segments_are_encoded_as_in_the_whole_text():
    (one, _), (two, _) = alignment.first_tokenizer(FIRST), alignment.second_tokenizer(SECOND)
    assert alignment.separable(one, two)
    for n in range(3000):
        text = mixed_text(n)
        own = alignment.SEGMENT.findall(" " + text)
        assert "".join(own) == " " + text
        assert [t for s in own for t in one.encode_ordinary(s)] == one.encode_ordinary(" " + text)
        if "▁" not in text:
            assert [t for s in own for t in two.encode(s[1:])] == two.encode(text)


def test_a_file_without_ordered_ids_uses_the_general_encoder(tmp_path):
    import json

    with open(FIRST, encoding="utf-8") as file:
        data = json.load(file)
    data["model"]["merges"][300], data["model"]["merges"][301] = data["model"]["merges"][301], data["model"]["merges"][300]
    (tmp_path / "other.json").write_text(json.dumps(data))
    assert not hasattr(alignment.first_tokenizer(str(tmp_path / "other.json"))[0], "encode_ordinary")
    assert hasattr(alignment.first_tokenizer(FIRST)[0], "encode_ordinary")


def test_groups_are_a_real_output(spark):
    frame = spark.createDataFrame([(1, "Hello tokenizers, 中文!", "", "", "")], SCHEMA)
    row = alignment.align(frame, with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    assert row["groups"].count(";") + 1 == row["n_groups"]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert values(queries.QUERIES["op11_token_alignment"](spark, SF)) == plain(rows)
