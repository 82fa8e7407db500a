import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from structdoc.llm import pieces as P
from structdoc.llm.sharding import CapacityTree, best_fit_decreasing, fit_into, rounded, shard

from tests.llm.fixtures import docs, empty, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  a  b ", "\x00a", "▁a ▁ b", "日本 é\n\n\t x", " " * 100, "a" * 1000, "tab\tand  two spaces", "x ▁ y"]


def test_digests_are_those_of_the_library(spark):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for r in rows():
        ids = library.encode(r[1] or "")
        text = library.decode(ids) if ids else ""
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = P.digest_pieces(docs(spark), MODEL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert P.digest_pieces(empty(spark), MODEL).collect() == []


def test_parts_of_long_texts_give_the_same_ids(monkeypatch):
    codec = P.codec(MODEL)
    monkeypatch.setattr(P, "LONG", 40)
    for text in ODD + [r[1] for r in rows()[:40] if r[1]]:
        assert [i for part in codec.parts(text) for i in codec.library.encode(part)] == codec.library.encode(text)


@pytest.mark.parametrize("text", ODD)
def test_offsets_are_those_of_the_library(text):
    codec = P.codec(MODEL)
    ids, edges = codec.encode(text)
    proto = codec.library.encode(text, return_type="proto")
    found = proto["pieces"] if isinstance(proto, dict) else proto.pieces
    begins = [p["begin"] if isinstance(p, dict) else p.begin for p in found]
    assert edges[:-1].tolist() == begins and edges[-1] == len(text.encode())


def test_encode_and_decode(spark):
    data = list(enumerate(ODD)) + [(100, None)]
    encoded = P.encode_with_offsets(spark.createDataFrame(data, "doc_id long, text string"), MODEL)
    back = {r.doc_id: r.text for r in P.decode_pieces(encoded, MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert back == {i: library.decode(library.encode(t)) if t else "" for i, t in data}


def test_longest_prefix_in_a_compiled_map():
    """A trie made by hand: 'a' -> 'x', 'ab' -> 'yz'."""
    units = [0] * 1024
    leaf = lambda v: v | 1 << 31
    units[0] = 1 << 10  # root's children at 1 ^ byte
    a = 0 ^ 1 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | 4 << 10
    base = a ^ 4
    units[base] = leaf(0)
    b = base ^ ord("b")
    units[b] = ord("b") | 1 << 8 | 8 << 10
    units[b ^ 8] = leaf(2)
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0"
    found = P.CharacterMap(blob)
    assert found.longest(b"abc", 0) == (b"yz", 2) and found.longest(b"ac", 0) == (b"x", 1) and found.longest(b"c", 0) is None


def field(number, value):
    """A length-delimited field of a protobuf message."""
    size, out = len(value), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + value


@pytest.fixture(scope="module", params=[(1, 1, 1), (0, 0, 1), (1, 0, 1), (0, 1, 1)])
def mapped(request, tmp_path_factory):
    """The public model's pieces behind the library's own character map; dummy prefix, squeezed spaces and escapes as asked."""
    spec = dict(P._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    rules = dict(P._fields(spec))
    assert len(rules[2]) > 100_000
    new = field(1, b"nmt_nfkc") + field(2, rules[2]) + bytes(x for n, v in zip((3, 4, 5), request.param, strict=True) for x in (n << 3, v))
    body = b"".join(field(n, v) for n, v in P._fields(open(MODEL, "rb").read()) if n != 3 and isinstance(v, bytes))
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(body + field(3, new))
    return str(path)


MAPPED = ["ＡＢ  ½ é", "  ① two\u3000three  ", "ﬁne ㌔ ﷺ", "a\u200bb\u00adc", "\t\n x \r\n", "가각 각", "Å ≠ ①②③", "™ and ℡ ", "e\u0301\u0301 o\u0308", "▁ ▁a", "", "   "]


@pytest.mark.parametrize("text", MAPPED + ODD)
def test_offsets_through_a_character_map_are_those_of_the_library(mapped, text):
    codec = P.codec(mapped)
    assert codec.map.units
    ids, edges = codec.encode(text)
    proto = codec.library.encode(text, return_type="proto")
    found = proto["pieces"] if isinstance(proto, dict) else proto.pieces
    get = lambda p, k: p[k] if isinstance(p, dict) else getattr(p, k)
    data = text.encode()
    assert ids == [get(p, "id") for p in found]
    assert [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)] == [(get(p, "begin"), get(p, "end")) for p in found]
    assert all(0 <= a <= b <= len(data) for a, b in zip(edges[:-1], edges[1:], strict=True))


def test_tree_finds_the_tightest_bin():
    rng, tree, held = random.Random(1), CapacityTree(), []
    for i in range(2000):
        if held and rng.random() < 0.4:
            key = held.pop(rng.randrange(len(held)))
            tree.remove(key)
        else:
            key = rng.randrange(10**6)
            if key not in held:
                held.append(key)
                tree.add(key)
        size = rng.randrange(10**6)
        assert tree.tightest(size) == min((k for k in held if k >= size), default=None)


def one_by_one(sizes, capacity):
    """Best-fit-decreasing of single items with a list of bins: the bins' contents."""
    rooms, bins = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fits:
            i = min(fits)[1]
        else:
            rooms.append(max(capacity, size))
            bins.append([])
            i = len(rooms) - 1
        rooms[i] -= size
        bins[i].append(size)
    return bins


def unpack(histogram, segments):
    sizes, bins = [s for s, n in histogram for _ in range(n)], defaultdict(list)
    for start, first, per, n in segments:
        for i in range(n):
            bins[first + i // per].append(sizes[start + i])
    assert sum(map(len, bins.values())) == len(sizes)
    return bins


def test_packing_a_histogram_equals_packing_items():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, rng.choice([6, 25, 70])) for _ in range(rng.randint(0, 120))]
        histogram = sorted(Counter(sizes).items(), reverse=True)
        segments, opened = best_fit_decreasing(histogram, capacity)
        bins = unpack(histogram, segments)
        assert opened == len(bins) and sorted(map(sum, bins.values())) == sorted(map(sum, one_by_one(sizes, capacity)))  # bins with equal room are alike


def test_fit_into_is_the_least_capacity():
    """Against a search over all capacities by packing one item after the other."""
    rng = random.Random(10)
    for _ in range(60):
        sizes = [rng.randint(8, rng.choice([20, 60])) for _ in range(rng.randint(5, 80))]
        shards = rng.randint(2, 6)
        histogram = sorted(Counter(sizes).items(), reverse=True)
        found = [sum(b) for b in unpack(histogram, fit_into(histogram, shards)).values()]
        mean = sum(sizes) / shards
        if max(sizes) > mean:
            continue
        least = next(c for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1) if len(one_by_one(sizes, c)) <= shards)
        assert len(found) <= shards and max(found) <= least * 1.06 + 1
    assert fit_into([], 3) == []
    alone = unpack([(1000, 2), (3, 40)], fit_into([(1000, 2), (3, 40)], 4))
    assert sorted(map(sum, alone.values())) == [60, 60, 1000, 1000]


def test_shards_hold_groups_and_are_near_equal(spark):
    data = [(i, "t%d " % (i % 150) * (1 + i % 7)) for i in range(900)]
    out = shard(spark.createDataFrame(data, "doc_id long, text string"), n_shards=6, slot_rows=20).collect()
    check(data, out, 6)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 6


def check(data, out, shards):
    texts = defaultdict(list)
    for i, t, *_ in data:
        texts[i].append(t)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
        assert (r.size, r.text_crc32) in [(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts[r.doc_id]]
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert len(out) == len(data) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())


def test_shards_of_awkward_rows(spark):
    check(rows(), shard(docs(spark)).collect(), 24)
    assert shard(empty(spark)).collect() == []


def test_slots_do_not_depend_on_the_layout(spark):
    frame = docs(spark)
    key = lambda out: sorted(map(tuple, out.where("doc_id is not null").collect()))
    assert key(shard(frame, n_shards=3)) == key(shard(frame.repartition(2, "n_chars"), n_shards=3))


def test_fixed_capacity(spark):
    data = [(i, "x" * (i + 1)) for i in range(92)]
    out = shard(spark.createDataFrame(data, "doc_id long, text string"), capacity=200).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    total = sum(sizes.values())
    assert max(sizes.values()) <= 200 and len(sizes) <= -(-total // 200) * 11 // 9 + 1


def test_many_small_groups_at_a_fixed_capacity(spark):
    data = [(i, f"{i:033d}") for i in range(20_000)]
    out = shard(spark.createDataFrame(data, "doc_id long, text string"), capacity=4000, slot_rows=3000).collect()
    check(data, out, 300)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 4000 and len(sizes) == -(-20_000 // (4000 // 41))


def test_sizes_are_rounded_up_to_sixteen_digits(spark):
    sizes = [1, 41, 65535, 65536, 65537, 131071, 10**9 + 7, 2**40 + 1]
    out = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "bytes long").select(rounded(F.col("bytes"))).collect()]
    assert out[:4] == sizes[:4] and all(s <= r < s * (1 + 2**-15) and bin(r).rstrip("0").count("") <= 19 for s, r in zip(sizes, out, strict=True))
