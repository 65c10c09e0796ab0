"""Filter audit, sharding and token alignment against brute-force versions and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memlake.llm import alignment, filter_audit, registry, sharding

PATH = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, size string, digest int, shard string, part int"
LABELS = "doc_id bigint, quality int, toxic int"
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG_TEXTS = [" " * 2_000_000, "a" * 2_000_000, "字" * 2_000_000]
ODD_TEXTS = ["", None, " \n\t ", "a", "a" * 70_000, "word " * 9_000, "é\u0085 日本語 👩‍👩‍👧", "\0x\0", "▁ a ▁", "<|endoftext|> <s> </s> <0x41>", "  two  blanks  ",
             "Same same SAME", "Same same SAME", "x|y", " a\xa0b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s" if i % 2 else None, "x", 1, "y", 3) for i, t in enumerate(ODD_TEXTS)]
    more = [rows[3], (None, "a", "", "x", 1, "y", 3), (None, "a", "", "x", 1, "y", 3), (None, None, None, None, None, None, None), (-5, "only here", "t", "x", 1, "y", 3)]
    return spark.createDataFrame(rows + more, DOCS)


# the filter audit

def _plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def _plain_audit(rows, labels):
    """Every filter applied in every order, row by row."""
    least, told = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, quality, toxic in labels:
        good, bad = told.get(doc_id, (0, 0))
        told[doc_id] = (good or int(quality == 1), bad or int(toxic == 1))
    told.pop(None, None)
    judged = []
    for doc_id, text, source in rows:
        words, distinct, capitals, points, symbols = _plain_measures(text or "")
        first = least.get(text or "")
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0,
                 "E": first is not None and (doc_id is None or first < doc_id)}
        judged.append((source or "", {f for f, bad in fails.items() if bad}, *told.get(doc_id, (0, 0))))
    out, removals = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in judged}:
            left = [j for j in judged if j[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [j for j in left if f in j[1]]
                redundant = sum(f in j[1] for j in gone)
                left, gone = [j for j in left if f not in j[1]], gone + removed
                out[part, order, step] = (len(left), len(removed), redundant, sum(j[0] == part and j[1] == {f} for j in judged),
                                          sum(j[2] for j in removed), sum(j[3] for j in removed))
                removals[part, f] += len(removed)
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_by_brute_force(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    told = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert _audited(filter_audit.audit(docs, labels)) == _plain_audit(rows, told)


def test_audit_of_odd_rows(spark, odd):
    told = [(3, 1, 0), (3, 0, None), (11, 1, 1), (12, 1, 1), (None, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame(told, LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert _audited(filter_audit.audit(odd, labels)) == _plain_audit(rows, told)
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    assert _audited(filter_audit.audit(odd, labels.limit(0))) == _plain_audit(rows, [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b", "|", " ", "\n", "\x0b", "\x1c", "é", "字", "👧", "12345678", "12345678x", "w" * 64, "w" * 65, "\0"]), max_size=40).map("".join), max_size=6))
def test_measures_by_the_plain_patterns(texts):
    assert filter_audit.measures([t.encode() for t in texts]).tolist() == [list(_plain_measures(t)) for t in texts]


def test_measures_of_long_texts():
    for text in LONG_TEXTS + ["ab " * 300_000, " ".join(map(str, range(200_000)))]:
        assert filter_audit.measures([text.encode()]).tolist() == [list(_plain_measures(text))]


def test_spans_of_one_hash_are_told_apart():
    """With equal hashes only the comparison of bytes decides."""
    class Same(filter_audit.Spans):
        def hashes(self):
            return np.zeros(len(self.start), np.uint64)
    words = ["x", "y", "x", "long" * 20, "long" * 20 + "r", "long" * 20, "12345678a", "12345678b", "y"] * 3
    data = np.frombuffer((" ".join(words) + " " * 9).encode(), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    assert Same(data, start, size, np.arange(27) // 9).distinct(3).tolist() == [6, 6, 6]


# sharding

def _plain_shards(rows, n=8):
    """Shard of each row of the whole order by middles, small groups of equal texts as one piece."""
    def digest(text):
        return hashlib.md5((text or "").encode()).hexdigest()
    order = sorted(rows, key=lambda r: (digest(r[1]), r[0] is not None, r[0] or 0))
    size = [len((t or "").encode()) + 1 for _, t in order]
    total, largest, bytes_of = sum(size), max(size, default=0), Counter()
    for (_, t), s in zip(order, size):
        bytes_of[digest(t)] += s
    out, at, start = [], 0, {}
    for (i, t), s in zip(order, size):
        d = digest(t)
        start.setdefault(d, at)
        if bytes_of[d] <= largest:
            shard = (2 * start[d] + bytes_of[d]) * n // (2 * total)
        else:
            shard = (2 * at + s) * n // (2 * total)
        out.append((i, s, zlib.crc32((t or "").encode()), shard))
        at += s
    slots = Counter()
    rows = []
    for i, s, crc, shard in out:
        rows.append((i, s, crc, shard, slots[shard]))
        slots[shard] += 1
    return rows


def _by_nulls_first(rows):
    return sorted(rows, key=lambda r: (r[3], r[4], r[0] is not None, r[0] or 0))


def _sharded(df, n=8):
    return [(r.row.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.sharded(df, n).collect()]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_by_brute_force(spark, shards):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _by_nulls_first(_sharded(docs, shards)) == _by_nulls_first(_plain_shards(rows, shards))


def test_shards_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _by_nulls_first(_sharded(odd)) == _by_nulls_first(_plain_shards(rows))
    assert _sharded(odd.limit(0)) == []
    few = spark.createDataFrame([(1, ""), (2, "b")], "doc_id bigint, text string")
    assert _by_nulls_first(_sharded(few)) == _by_nulls_first(_plain_shards([(1, ""), (2, "b")]))


def test_groups_stay_whole_unless_large(spark):
    rows = [(i, "copy of a third" if i % 3 == 0 else f"text {i // 6} " * 9 if i % 3 == 1 else f"own {i} " * (i % 37)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = _sharded(docs)
    assert _by_nulls_first(got) == _by_nulls_first(_plain_shards(rows))
    sizes = Counter()
    where = {}
    for i, s, crc, shard, _ in got:
        sizes[shard] += s
        where.setdefault(crc, set()).add(shard)
    largest = max(s for _, s, *_ in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    third = where.pop(zlib.crc32(b"copy of a third"))
    assert len(third) > 1 and all(len(s) == 1 for s in where.values())


def test_shard_files_hold_every_row(odd, spark, tmp_path):
    docs = odd.withColumn("a.b", F.lit(1))
    name = sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and back.drop(name).columns == docs.columns
    assert back.drop(name).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert Counter(r[0] for r in back.select(name).collect()) == Counter(s for *_, s, _ in _sharded(odd))


# alignment

def _plain_alignment(rows):
    """Each text on its own: ends of both token rows, groups between common ends, links where they end together."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    out, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common, links, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for e in common:
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        counts.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, n, m, len(k), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), d) for i, n, m, k, d in out]


def _ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_alignment_by_brute_force(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    want = _plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n > 0 for _, n, *_ in want) > 100
    assert _ordered(registry.queries()["op13_token_alignment"](spark, PATH).collect()) == _ordered(want)


def test_alignment_of_odd_rows(spark, odd):
    want = _plain_alignment([(r.doc_id, r.text) for r in odd.collect()])
    assert _ordered(alignment.aligned(odd, BYTE_LEVEL, PIECES).collect()) == _ordered(want)
    assert alignment.aligned(odd.limit(0), BYTE_LEVEL, PIECES).count() == 0


def test_long_texts_are_aligned():
    pair = alignment.Pair.load(BYTE_LEVEL, PIECES)
    got = alignment.align(pair, LONG_TEXTS)
    assert all(n > 0 for n in got.n_a) and got.n_groups[1] > 0


def test_links_are_suffixes():
    a, b = [b"x", b"ax", b"bx", b"", b"long"], [b"x", b"cax", b"ng", b"q"]
    pairs = {divmod(int(p), len(b)) for p in alignment.possible_pairs(a, b)}
    assert pairs == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))}


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.load(BYTE_LEVEL, PIECES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\u3000", "'s", "'", "12", "é", "字", "▁", "<s>", "!?", "\0", "Été"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_parts_encode_like_whole_texts(pair, texts):
    a_ids, a_at, b_ids, b_at = pair.encode(texts)
    assert pair.apart
    for i, t in enumerate(texts):
        assert a_ids[a_at == i].tolist() == (pair.a.encode(" " + t, add_special_tokens=False).ids if t else [])
        assert b_ids[b_at == i].tolist() == (pair.b.encode(t) if t else [])
