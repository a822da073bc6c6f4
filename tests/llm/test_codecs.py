"""The parts that need no Spark, against brute force and exact round trips."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import ann, mpeg_audio, ngram_lm, packing, pfor, quality, shingles, tokenizers
from tracelake.llm.byte_bpe import ByteBpe, may_stay_together
from tracelake.llm.merge_codec import BLANK, MergeCodec
from tracelake.llm.minhash import link_components, rows_per_band

ODD = ["", " ", "  ", "\n", "a", " a  b ", "x\n\n\n y", "▁", "a ▁b▁", "日本 語\n", "é ﬁ 🙂🙂", "<|endoftext|> <s>", "\x00 a", "a\r\nb  c", "x" * 3000, " " * 900 + "x", "don't  STOP!! 123 4567", "ab　c​d"]


@pytest.fixture(scope="module")
def pieces():
    return MergeCodec(tokenizers.path("piece_bpe_32k.model"), cache_words=50)


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(tokenizers.path("byte_bpe_50k.json"))


def test_merges_equal_the_library(pieces):
    rng = random.Random(3)
    bits = ["a", "the", "▁", " ", "  ", "\n", ",", "!!", "é", "🙂", "ing", "1", "22", "Übung", "er"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids = pieces.encode_batch(texts)
    assert ids == [pieces.library.encode(t) for t in texts]
    assert pieces.decode_batch(ids) == [pieces.library.decode(i) if i else "" for i in ids]
    assert pieces.agenda(BLANK + "x" * 100) == tuple(pieces.library.encode("x" * 100))


def test_wrong_merges_are_noticed(pieces):
    with pytest.raises(ValueError):
        broken = MergeCodec(tokenizers.path("piece_bpe_32k.model"))
        broken.agenda = lambda text: tuple(pieces.agenda(text)[:-1]) or (0,)
        broken.encode_batch(["a new text", "of, some!words"])
    inner = MergeCodec(tokenizers.path("piece_bpe_32k.model"))
    inner.agenda = lambda text: pieces.agenda(text) if text[0] == BLANK else (0,)  # wrong only behind an inner cut
    with pytest.raises(ValueError):
        inner.encode_batch(["plain", "日本 語\n x\ny"])


def test_byte_ids_equal_the_library(bpe):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\ta1'.é世") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_byte_ids_of_the_whole_table(bpe):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_words_stay_together_where_no_merge_reaches(bpe):
    rng = random.Random(6)
    marks = list("ab tsrvmld'' \n\t!.,-019(|~") + [" ", "\u0085", "　", "’", "é", "à", "日", "²", "́", "\x00", "\x1c", "😀", "'ll", "  ", "!!'", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(20000)]
    texts += [f"ab{h} x {h}{h}a1{h}!{h} 1 !{h}\n{h}'s{h}' {h}  {h}." for h in map(chr, range(0x3100))]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids
    cut = lambda text: [w.replace("Ġ", " ") for w, _ in bpe.coarse.pre_tokenizer.pre_tokenize_str(text)]
    assert cut("one line, of 7 words, stays together") == ["one line, of 7 words, stays together"]
    assert cut("don't  cut wrongly!!'") == ["don", "'t", " ", " cut wrongly", "!!'"]


def test_a_file_whose_merges_reach_over_cuts_is_used_as_it_is(bpe, tmp_path):
    import json

    file = json.loads(bpe.library.to_str())
    assert may_stay_together(file) and bpe.coarse is not bpe.library
    for left, right in (("a", "Ġb"), ("a", "1"), ("1", "."), (".", "a"), ("é", "Ġ")):
        assert not may_stay_together(file | {"model": file["model"] | {"merges": [[left, right]]}})
        assert not may_stay_together(file | {"model": file["model"] | {"merges": [f"{left} {right}"]}})
    assert not may_stay_together(file | {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}})
    (tmp_path / "other.json").write_text(json.dumps(file | {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}))
    other = ByteBpe(str(tmp_path / "other.json"))
    assert other.coarse is other.library


def test_other_ids_are_found():
    from tokenizers import Tokenizer, pre_tokenizers

    broken = ByteBpe(tokenizers.path("byte_bpe_50k.json"))
    broken.coarse = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    broken.coarse.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    with pytest.raises(RuntimeError, match="other ids"):
        broken.encode_batch(["a text"])


def test_added_tokens_have_their_ids(bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"{end}\n{end}  ", f"x{end}y", "<|endoftext|", "<| endoftext |>", f"{'y' * 900}{end}"]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encode_batch(texts[:1])[0], "<u4").tolist() == [64, 220, 50256, 275]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200), st.floats(1, 100))
def test_pfor_round_trip(values, percentile):
    v = np.array(values, dtype=np.uint32)
    data = pfor.encode(v, percentile)
    assert (pfor.decode(data) == v).all()
    if len(v) > 3:
        assert (pfor.decode(data, 0, 2, len(v) - 1) == v[2:-1]).all()


def test_pfor_file():
    ids = np.arange(5000, dtype=np.uint32) % 700
    data = pfor.write_file(np.array([5, 7, 9]), np.array([0, 4000, 1000]), ids)
    doc_ids, lengths, back = pfor.read_file(data)
    assert doc_ids.tolist() == [5, 7, 9] and lengths.tolist() == [0, 4000, 1000] and (back == ids).all()
    assert (pfor.read_range(data, 3990, 4010) == ids[3990:4010]).all()
    with pytest.raises(ValueError):
        pfor.read_file(b"x" + data[1:])
    assert len(pfor.encode(np.array([1] * 255 + [2**31]))) < 400  # one outlier does not widen its block


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fills_every_slot_once(histogram):
    slots = packing.plan_slots(histogram, 64)
    used: dict[int, list[tuple[int, int]]] = {}
    for length, rank, n, first, offset in slots:
        for k in range(n):
            used.setdefault(first + k, []).append((offset, length))
    assert sum(n for _, _, n, _, _ in slots) == sum(histogram.values())
    for length, n in histogram.items():
        assert sorted(r for x, rank, m, _, _ in slots if x == length for r in range(rank, rank + m)) == list(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    bins: list[int] = []  # best-fit decreasing, piece by piece
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = min((k for k, room in enumerate(bins) if room >= length), key=bins.__getitem__, default=None)
        if at is None:
            bins.append(64 - length)
        else:
            bins[at] -= length
    assert len(used) == len(bins)


def test_sketch_estimates_and_does_not_depend_on_rounds():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for n, m in ((3, 3), (40, 30), (500, 450), (3000, 2500)):
        a, b = np.unique(pool[:n]), np.unique(pool[n - m : 2 * n - m])
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = np.mean([(shingles.fast_sketch(shingles.mix(a + np.uint64(k)), 300) == shingles.fast_sketch(shingles.mix(b + np.uint64(k)), 300)).mean() for k in range(20)])
        assert abs(est - same) < 0.05
    assert len(set(shingles.fast_sketch(pool[:1], 300).tolist())) == 300
    assert rows_per_band(0.85) > rows_per_band(0.8) > 1


def test_shingles_follow_the_contract():
    assert len(shingles.shingle_set("", 3)) == len(shingles.shingle_set(" \t\n\x0b\x0c\r ", 3)) == 0
    assert len(shingles.shingle_set("one two", 3)) == 1
    assert (shingles.shingle_set("A b C d", 3) == shingles.shingle_set("a B\nc\td", 3)).all()
    assert len(shingles.word_hashes("a b c")) == 2 and len(shingles.shingle_set("É x y", 3)) == 1
    assert (shingles.shingle_set("É x y", 3) != shingles.shingle_set("é x y", 3)).all()


def test_link_components_loses_none():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**40, 100))
    sets = [np.unique(np.concatenate((rng.choice(base, 94, replace=False), rng.integers(0, 2**40, 3)))) for _ in range(700)] + [np.unique(rng.integers(0, 2**40, 50))]
    links = link_components(sets, np.arange(len(sets)), 85)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}

    def classes(pairs):
        group = list(range(len(sets)))
        for a, b in pairs:
            x, y = group[a], group[b]
            if x != y:
                group = [x if g == y else g for g in group]
        return {frozenset(k for k, g in enumerate(group) if g == h) for h in set(group)}

    assert classes(links) == classes(want)


def test_bloom_counts_never_too_small():
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = rng.integers(1, 3000, len(hashes))
    part = np.frombuffer(ngram_lm.build_part(hashes, counts), dtype=np.uint8)
    level, exact = ngram_lm.probe_levels(part, hashes), 1 + np.floor(np.log2(counts)).astype(int)
    assert (level >= exact).all() and (level == exact).mean() > 0.97
    assert (ngram_lm.probe_levels(part, shingles.mix(hashes)) > 0).mean() < 0.03


def test_audio_round_trip_and_damage():
    for n in (0, 1, 64, 1416, 1417, 1418, 70_000):
        content = os.urandom(n) if n % 2 else bytes(n)
        assert mpeg_audio.payload(mpeg_audio.build(content)) == content
    stream = mpeg_audio.build(b"abc" * 3000)
    a = mpeg_audio.parse(stream)
    assert a.duration == a.frames * 1152 / mpeg_audio.Fraction(32000) and a.table["frames"] == a.frames and a.crc_bad == 0
    assert mpeg_audio.seek(a, 0) == a.offsets[0] and mpeg_audio.seek(a, a.duration) == a.offsets[-1]
    junk = stream[: a.offsets[2]] + b"\xff\xfbjunk\xff" + stream[a.offsets[2] :] + b"TAG" + bytes(125)
    b = mpeg_audio.parse(junk)
    assert (b.frames, b.resyncs, b.skipped) == (a.frames, 1, 7) and "ID3v1" in b.tags
    bad = bytearray(stream)
    bad[a.offsets[1] + 8] ^= 1
    assert mpeg_audio.parse(bytes(bad)).crc_bad == 1
    with pytest.raises(ValueError):
        mpeg_audio.payload(bytes(bad))
    changed = bytearray(stream)
    changed[a.offsets[1] + 100] ^= 1
    with pytest.raises(ValueError):
        mpeg_audio.payload(bytes(changed))
    assert mpeg_audio.parse(b"").frames == mpeg_audio.parse(b"no audio \xff\xff\xff").frames == 0
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_audio_of_texts_with_a_tags_mark():
    for n, at in ((128, 29), (192, 65), (1408, 1289)):
        content = (b"x" * at + b"TAG").ljust(n, b"x")
        stream = mpeg_audio.build(content)
        assert stream[-128:-125] == b"TAG"
        assert mpeg_audio.payload(stream) == content and "ID3v1" not in mpeg_audio.parse(stream).tags
        tagged = mpeg_audio.parse(stream + b"TAG" + bytes(125))
        assert mpeg_audio.payload(stream + b"TAG" + bytes(125)) == content and tagged.tags["ID3v1"] == bytes(125)


def _frame(version=3, layer=1, bitrate=9, rate=0, mode=3, extension=0, body=b"", padding=0, size=None):
    """A protected frame with its checksum over the bits that `covered_bits` names, counted here by hand."""
    word = 0x7FF << 21 | version << 19 | layer << 17 | 0 << 16 | bitrate << 12 | rate << 10 | padding << 9 | mode << 6 | extension << 4
    head = word.to_bytes(4, "big")
    h = mpeg_audio.header(word)
    rest = body.ljust((size or h.size) - 6, b"\x55")
    return h, head, rest


def _bitwise_crc(bits: str) -> int:
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(b) else 0)
    return crc


def _bits(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def test_audio_checksums_of_all_layers():
    # Layer I, stereo: 32 subbands of 4 bits for 2 channels; joint stereo from subband 4 on: 4 * 2 + 28
    # Layer II, mono, 64 kbit/s at 44.1 kHz (table a): 11 * 4 + 12 * 3 + 4 * 2 bits, and 2 for each subband that has any
    two = "0000" * 10 + "0001" + "000" * 11 + "111" + "00" * 4
    low = "0110" * 4 + "000" * 7 + "00" * 19  # MPEG 2
    cases = [({"layer": 3, "mode": 0}, "", 256), ({"layer": 3, "mode": 1, "extension": 0}, "", 144), ({"layer": 2, "bitrate": 4, "mode": 3}, two, 88 + 4), ({"layer": 2, "bitrate": 4, "mode": 3, "version": 2}, low, 16 + 21 + 38 + 8)]
    for how, start, covered in cases:
        body = int(start.ljust(1024, "0"), 2).to_bytes(128, "big") if start else bytes(range(128))
        h, head, rest = _frame(**how, body=body)
        crc = _bitwise_crc(_bits(head[2:]) + _bits(rest)[:covered])
        frame = head + crc.to_bytes(2, "big") + rest
        assert mpeg_audio.covered_bits(frame, 0, h) == covered and len(frame) == h.size
        a = mpeg_audio.parse(frame * 3)
        assert (a.frames, a.crc_checked, a.crc_bad, a.layer) == (3, 3, 0, h.layer)
        bad = bytearray(frame * 3)
        bad[len(frame) + 7] ^= 1
        assert mpeg_audio.parse(bytes(bad)).crc_bad == 1


def test_audio_of_free_format_tags_and_delay():
    h, head, rest = _frame(bitrate=0, layer=1, mode=3, size=700)
    frame = head + _bitwise_crc(_bits(head[2:]) + _bits(rest)[: 8 * 17]).to_bytes(2, "big") + rest
    a = mpeg_audio.parse(frame * 5)
    assert (a.frames, a.skipped, a.crc_bad, a.duration) == (5, 0, 0, mpeg_audio.Fraction(5 * 1152, 44100)) and a.offsets.tolist() == [700 * k for k in range(5)]
    # a tag whose bytes were kept clear of syncs, and one with a footer
    body = b"PRIV" + (12).to_bytes(4, "big") + b"\0\0" + b"own\0" + b"\xff\xe0abcdef"
    stored = body.replace(b"\xff", b"\xff\x00")
    tag = b"ID3\x03\x00\x80" + bytes((len(stored) >> s & 127) for s in (21, 14, 7, 0)) + stored
    assert mpeg_audio.parse(tag + frame * 3).tags["PRIV:own"] == b"\xff\xe0abcdef" and mpeg_audio.parse(tag + frame * 3).offsets[0] == len(tag)
    four = b"TIT2" + bytes([0, 0, 0, 4]) + b"\0\0" + b"\x03abc"
    with_footer = b"ID3\x04\x00\x10" + bytes([0, 0, 0, len(four)]) + four + b"3DI\x04\x00\x10" + bytes([0, 0, 0, len(four)])
    b = mpeg_audio.parse(with_footer + frame * 3)
    assert b.tags["TIT2"] == b"\x03abc" and b.offsets[0] == len(with_footer) and b.skipped == 0
    # delay and padding of an encoder
    h, head, rest = _frame(mode=3)
    info = bytes(17) + b"Info" + (1).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    first = head + _bitwise_crc(_bits(head[2:]) + "0" * 136).to_bytes(2, "big") + info.ljust(h.size - 6, b"\0")
    plain = head + _bitwise_crc(_bits(head[2:]) + _bits(rest)[:136]).to_bytes(2, "big") + rest
    c = mpeg_audio.parse(first + plain * 7)
    assert (c.frames, c.delay, c.padding, c.table["encoder"]) == (7, 576, 1000, "LAME3.100") and c.heard == mpeg_audio.Fraction(7 * 1152 - 1576, 44100)


def test_kd_tree_is_exact_and_chi_square():
    rng = np.random.default_rng(6)
    points = rng.standard_normal((700, 4))
    d = np.concatenate([d for d, _ in ann.KdTree(points).ascending(points[5])])
    assert len(d) == 700 and (np.diff(d) >= 0).all()
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert len(ann.KdTree(np.ones((500, 4))).leaves) == 1


def test_quality_features():
    buckets, style = quality.text_features("One two ONE two")
    assert len(buckets) == 4 + 3 and buckets[0] == buckets[2] and buckets[4] == buckets[6] >= quality.BUCKETS and len(style) == quality.STYLE
    assert len(quality.text_features("")[0]) == 0 and np.isfinite([quality.text_features(t)[1] for t in ("", "a b", "!!! ???")]).all()
    cells = [quality.metadata_cell(*m) for m in ((None, "en", 5), ("", "en", 5), ("x", None, None), ("x", "en", 2**60), ("x", "en", -3))]
    assert len(set(cells)) == 5 and quality.cell_design(np.array(cells)).sum(axis=1).tolist() == [3] * 5
    odds = np.arange(2 * quality.BUCKETS, dtype=float)
    got = quality.means_of(odds, [buckets, np.zeros(0, "<u2"), buckets[:1]])
    assert np.allclose(got, [[odds[buckets[:4]].mean(), odds[buckets[4:]].mean()], [0, 0], [odds[buckets[0]], 0]])
