"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

from __future__ import annotations

import glob
import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import ann, linededup, media, minhash, ngram_lm, packing, quality, queries, sentencepieces, token_files, tokenizers, warc
from tracelake.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, key long, __text string, quality_score double, ids binary, _id string, _lines string, _text_key long, n_lines string, n_removed long, _row long, _deal string"
LINES = ["first line here", "second one follows", "third closes it", "and a fourth one"]
TEXTS = [
    (0, "\n".join(LINES)), (1, "intro\n" + "\n".join(LINES[:3]) + "\nend"), (2, "\n".join(LINES)), (2, "\n".join(LINES)), (3, None), (4, ""), (5, " \n\t "),
    (6, "alone\nwith two"), (7, "alone\nwith two"), (8, "word " * 9000), (9, "one two three four five six seven eight nine ten"), (10, "One two three four five six seven eight nine TEN"),
    (None, "nobody's text"), (11, "é 日本 🙂 mixed"), (12, "a\n" * 8 + "a"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "p", 1, "clash", 2.0, b"x", "own", "own", 5, "m", 9, 77, "d") for i, t in rows], SCHEMA)


def test_sentencepiece(spark):
    got = {(r["doc_id"], r["decoded_sha256"], r["n_tokens"]) for r in sentencepieces.sentencepiece_columns(docs(spark), tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "decoded_sha256")).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    assert got == {(i, hashlib.sha256((t or "").encode()).hexdigest(), len(sp.encode(t or ""))) for i, t in TEXTS}
    assert sentencepieces.sentencepiece_columns(docs(spark, []), tokenizers.path("piece_bpe_32k.model")).count() == 0


def brute_components(rows, width, percent):
    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted((repr(i), len(s), repr(least[g])) for (i, _), s, g in zip(rows, sets, group, strict=True))


def near_copies():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    base = list(rng.choice(words, 200))
    rows = []
    for k in range(60):  # copies of one text, each changed by itself, the original among the last
        w = list(base)
        for at in rng.integers(0, 200, 4 if k != 55 else 0):
            w[at] = f"x{k}-{at}"
        rows.append((100 + k, " ".join(w)))
    chain = list(rng.choice(words, 120))
    for k in range(12):  # a chain: each like the one before it
        chain = [*chain[6:], *rng.choice(words, 6)]
        rows.append((300 - k, " ".join(chain)))
    return rows + [(400 + k, " ".join(rng.choice(words, 80)) + " shared tail of ten words that many texts have here") for k in range(30)]


def test_near_duplicates(spark):
    for rows, width, percent in ((TEXTS, 3, 85), (near_copies(), 3, 85), (near_copies(), 5, 80)):
        got = minhash.near_duplicates(docs(spark, rows), width, percent).collect()
        assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute_components(rows, width, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    # buckets above a block, hot keys above their bound
    for size in (8, 3):
        got = minhash.near_duplicates(docs(spark, near_copies() + TEXTS), 3, 85, block=size, block_hashes=900, hot_rows=5).collect()
        assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute_components(near_copies() + TEXTS, 3, 85)
    kept = minhash.one_of_each_group(docs(spark), 3, 85)
    assert all((r["__text"], r["_id"], r["_text_key"], r["quality_score"]) == ("clash", "own", 5, 2.0) for r in kept.collect())
    assert kept.columns == docs(spark).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [0, 1, 3, 4, 5, 6, 8, 9, 11, 12, None]))
    assert minhash.near_duplicates(docs(spark, []), 3, 85).count() == 0


def test_near_duplicates_of_the_whole_table(spark):
    """Against a join of all documents that share any shingle."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in d.collect()]
    for width, percent in ((3, 85), (5, 80)):
        sets = []
        for _, t in rows:
            w = t.encode().lower().split()
            sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
        group, there, common = list(range(len(rows))), {}, Counter()
        for k, s in enumerate(sets):
            for x in s:
                for other in there.setdefault(x, []):
                    common[other, k] += 1
                there[x].append(k)
        for (a, b), c in common.items():
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c) and group[a] != group[b]:
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
        least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, width, percent).collect()}
        assert got == {i: (len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)}


def test_line_dedup(spark):
    got = {(r["doc_id"], r["text"], tuple(r["removed"])) for r in linededup.drop_repeated_lines(docs(spark)).collect()}
    assert (0, "\n".join(LINES), ()) in got and (1, "intro\nend", (1, 2, 3)) in got and (2, "", (0, 1, 2, 3)) in got
    assert (6, "alone\nwith two", ()) in got and (7, "", (0, 1)) in got
    assert (3, None, ()) in got and (4, "", ()) in got and (None, "nobody's text", ()) in got
    assert (12, "a", (1, 2, 3, 4, 5, 6, 7, 8)) in got  # the text's own windows repeat; only its first occurrence stays
    assert linededup.drop_repeated_lines(docs(spark, [])).count() == 0
    hot = [(k, "own " + str(k) + "\n" + "\n".join(LINES)) for k in range(50)]
    for bound in (5, 4096):
        got = linededup.drop_repeated_lines(docs(spark, hot), hot_rows=bound).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == [(k, hot[0][1] if k == 0 else f"own {k}") for k in range(50)]
        assert all((r["__text"], r["_id"], r["_lines"], r["n_lines"]) == ("clash", "own", "own", 5) for r in got)


def ids_of(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4")) for i, x in rows]


def test_packing(spark):
    pieces = packing.token_pieces(docs(spark), tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(pieces).collect()
    want = sorted(np.append(x, 0).astype("<u4").tobytes() for _, x in ids_of(TEXTS))
    whole: dict = {}
    for r in sorted(got, key=lambda r: (repr(r["doc_id"]), r["piece"], r["sequence_id"])):
        if r["doc_id"] != 2:
            whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert sorted([*whole.values(), *(bytes(r["ids"]) for r in got if r["doc_id"] == 2)]) == want
    room: dict = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == room.get(r["sequence_id"], 0) and (r["length"] == 2048 or r["piece"] == 0)
        room[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(room.values()) <= 2048 and len(room) == -(-sum(room.values()) // 2048)
    assert packing.pack(packing.token_pieces(docs(spark, []), tokenizers.path("byte_bpe_50k.json"))).count() == 0
    own = spark.createDataFrame([(k, 5, f"d{k}", f"r{k}", f"o{k}") for k in range(9)], "id long, length long, _deal string, _rank string, offset string")
    placed = packing.pack(own, capacity=12).collect()
    assert {(r["id"], r["_deal"], r["_rank"]) for r in placed} == {(k, f"d{k}", f"r{k}") for k in range(9)}
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 9 and {r["offset"] for r in placed} == {0, 5}


def test_token_files(spark):
    manifest = token_files.write_token_files(docs(spark), tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "t"), 2)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    rows = sorted(ids_of(TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    assert len(got) == len(rows)
    for r, (i, ids) in zip(got, rows, strict=True):
        ids = np.append(ids, 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, start, len(ids), ids.tobytes())
        start += len(ids)
    hot = [(7, f"text {k} " * 30) for k in range(60)] + [(None, "same")] * 40 + [(k, "x") for k in range(20)]
    manifest = token_files.write_token_files(docs(spark, hot).repartition(3), tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "t"), 2, file_tokens=300)
    assert manifest.where("seq > 0").count() > 3 and manifest.select("part").distinct().count() == 4
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert len(got) == len(hot) and order == sorted(order) and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((repr(i), np.append(x, 2).astype("<u4").tobytes()) for i, x in ids_of(hot))
    empty = token_files.write_token_files(docs(spark, []), tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "t"), 2)
    assert token_files.read_token_files(empty).count() == 0


def test_token_files_and_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "plain words"), (3, "<|endoftext|>"), (4, "the end")]
    want = [(i, library.encode(x, add_special_tokens=False).ids) for i, x in rows]
    manifest = token_files.write_token_files(docs(spark, rows), tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "t"), 2)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [(i, [*x, 2]) for i, x in want]
    assert [r["start"] for r in got] == [sum(len(x) + 1 for _, x in want[:k]) for k in range(4)]
    packed = packing.pack(packing.token_pieces(docs(spark, rows), tokenizers.path("byte_bpe_50k.json"))).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed} == {i: [*x, 0] for i, x in want}


def brute_scores(rows, trains):
    """What the model says with exact quantisation: (n_tokens, n_known, train_tokens, base_score, score) of each row."""
    words = [["<end>", *(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")), "<end>"] for _, t in rows]
    one, two = Counter(), Counter()
    for (i, _), w in zip(rows, words, strict=True):
        if trains(i):
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    n, kinds = sum(one.values()), len(one)
    share = lambda w: (one[w] + 0.1) / (n + 0.1 * (kinds + 1))
    out = []
    for w in words:
        score = 0.0
        for h, x in zip(w, w[1:], strict=False):
            q = two[h, x].bit_length()  # 1 + floor(log2 c)
            seen = (3 * 2 ** (q - 1) - 1) / 2 if q else 0.0
            score += math.log10((min(seen, one[h]) + ngram_lm.WEIGHT * share(x)) / (one[h] + ngram_lm.WEIGHT))
        out.append((len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, round(sum(math.log10(share(x)) for x in w[1:]), 5), round(score, 5)))
    return out


def test_language_model(spark):
    rows = TEXTS + [(20 + k, "the cat sat on the mat and the dog sat on the rug") for k in range(8)] + near_copies()[:20]
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    want = Counter((repr(i), *w) for (i, _), w in zip(rows, brute_scores(rows, lambda i: i is None or i % 4), strict=True))

    def scores(**how):
        got = ngram_lm.score_texts(docs(spark, rows).repartition(3), held, **how).collect()
        assert all(r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 4 == 0) for r in got)
        return got, Counter((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got)

    exact = scores(bits=400)
    assert exact[1] == want
    assert scores(bits=400, chunk_tokens=60, range_entries=40)[1] == want  # many chunks and ranges
    seen = next(r for r in exact[0] if r["doc_id"] == 24)
    assert seen["held_out"] and seen["score"] > seen["base_score"]
    rough = {(r["doc_id"], r["n_tokens"]): r["score"] for r in scores()[0]}
    off = [abs(rough[r["doc_id"], r["n_tokens"]] - r["score"]) / r["n_tokens"] for r in exact[0]]
    assert np.mean(off) < 0.05  # a probe that finds too much makes a token likelier, seldom
    assert ngram_lm.score_texts(docs(spark, []), held).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k % 3}", f"<p>é {k}</p>" * (k + 1), "clash") for k in range(40)] + [(7, None, None, "x"), (None, "u", "h", "y"), (8, "http://x/\r\nWARC-Type: revisit", "", "z")] + [(9, "again", "same", "z")] * 30, "page_id long, url string, html string, volume string")
    work = Workspace(spark, "t")

    def damage(page_id, data):
        return data[:-1] + bytes([data[-1] ^ 1]) if page_id in (5, 33) else data

    manifest = work.save("m", warc.write_volumes(warc.records(pages).repartition(3), {work.path("a"): None, work.path("b"): damage, work.path("c"): None}, volume_records=8))
    places = warc.placed(manifest)
    rows = places.orderBy("record_no").collect()
    assert [r["record_no"] for r in rows] == list(range(73)) and rows[0]["page_id"] is None and rows[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["length"] and b["page_id"] >= (a["page_id"] or -1) for a, b in zip(rows, rows[1:], strict=False))
    volumes = manifest.collect()
    assert max(r["n"] for r in volumes) == 8 and len(volumes) >= 10 and warc.leaves(manifest, 0).rdd.getNumPartitions() > 1
    # every record stands where the manifest says and has the headers that WARC/1.1 asks for, each once
    seen = []
    for v in volumes:
        data = gzip.decompress(open(v["paths"][0].removeprefix("file://"), "rb").read())
        for r in v["records"]:
            record = data[r["start"] : r["start"] + r["length"]]
            assert hashlib.sha256(record).hexdigest() == r["record_sha256"]
            head, _, body = record.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            names = [x.split(": ", 1)[0] for x in lines]
            assert version == "WARC/1.1" and len(names) == len(set(names)) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Target-URI"} <= set(names)
            fields = dict(x.split(": ", 1) for x in lines)
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
            assert body[int(fields["Content-Length"]) :] == b"\r\n\r\n" and fields["WARC-Type"] == "resource"
            seen.append((r["page_id"], fields["WARC-Target-URI"], body[:-4].decode(), fields["WARC-Record-ID"]))
    assert Counter(x[:3] for x in seen) == Counter((r["page_id"], (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"), r["html"] or "") for r in pages.collect())
    assert len({x[3] for x in seen}) == len({x[:3] for x in seen})

    wrong = warc.audit(warc.leaves(manifest, 0, 1), Workspace(spark, "t")).join(places, ["volume", "number"]).collect()
    assert {(r["page_id"], r["status"]) for r in wrong} == {(5, "corrupt"), (33, "corrupt")}
    assert warc.audit(warc.leaves(manifest, 0, 2), Workspace(spark, "t"), 0, 2).count() == 0
    at = volumes[3]["volume"]
    lost = warc.leaves(manifest, 0, 2).where((F.col("replica") == 0) | (F.col("volume") != at))
    assert warc.audit(lost, Workspace(spark, "t"), 0, 2).where("status = 'missing'").count() == volumes[3]["n"]
    path = volumes[4]["paths"][2].removeprefix("file://")
    cut = open(path, "rb").read()[:-5]
    with open(path, "wb") as f:
        f.write(cut)
    assert [(r["volume"], r["number"], r["status"]) for r in warc.audit(warc.leaves(manifest, 0, 2), Workspace(spark, "t"), 0, 2).collect()] == [(volumes[4]["volume"], volumes[4]["n"] - 1, "missing")]
    assert warc.write_volumes(warc.records(pages.limit(0)), {work.path("d"): None}).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (None, rows[4][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0, 10, stop=0.9999999).collect()
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and (i < 900 or i >= 1000)}
    for q in (0, 100, 200, 300, 1000):
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        assert [(r["rank"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 1000}
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_nearest_neighbours"](spark, sf).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchnumpy()
    x, ids = np.stack(rows["embedding"].tolist()).astype(float), rows["vec_id"]
    hit = 0
    wanted = ids[ids % 100 == 0]
    for q in wanted:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hit / (10 * len(wanted)) >= 0.9


def test_media(spark):
    streams = media.text_streams(docs(spark))
    got = sorted(((r["key"] is None, r["key"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.stream_digests(streams).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i is None, i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr)
    other = spark.createDataFrame([(1, b"no audio"), (2, None)], "key long, media binary")
    assert [r["frames"] for r in media.parsed_streams(other).orderBy("key").collect()] == [0, None]


def test_quality(spark):
    good, bad = "plain words make up this text and it goes on quite well", "BUY!! NOW!! $$$ *** WIN!! WIN!! WIN!!"
    rows = [(k, (bad if k % 5 == 0 else good) + f" n{k * 37 % 101}") for k in range(400)] + [(None, good), (900, None), (901, ""), (7, good + " again")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    out = quality.scored(d, model)
    got = {r["doc_id"]: r["quality_kept"] for r in out.collect()}
    assert all(got[k] == (k % 5 != 0) for k in range(400)) and out.count() == len(rows) and model.held_out_accuracy == 1.0
    again = quality.fit(d.repartition(5), labels)  # neither the order nor which of two texts comes first changes the model
    assert again.threshold == model.threshold and np.allclose(again.text.weights, model.text.weights, atol=1e-6)
    assert quality.fit(d, labels.where("quality = 1")) is None and quality.scored(d, None).where("quality_kept").count() == len(rows)
    kept = quality.kept_documents(d, labels)
    assert kept.columns == d.columns and all(r["quality_score"] == 2.0 for r in kept.collect())
    assert quality.scored(d.limit(0), None).count() == 0


def test_views_teach_each_other(spark):
    """A source that no label covers is learned from texts, a word that no label covers from sources."""
    rng, plain = np.random.default_rng(4), [f"word{k}" for k in range(300)]

    def row(k, good, word, source):
        own = ["fine", "firm"] if good else ["junk", "spam"]
        return (k, " ".join([*rng.choice(plain, 30), *rng.choice(word or own, 12)]), "en", source, 200)

    rows = [row(k, k % 2, None, "press" if k % 2 else "farm") for k in range(800)]
    rows += [row(1000 + k, k % 2, None, "newgood" if k % 2 else "newbad") for k in range(600)]
    rows += [row(2000 + k, k % 2, ["zork"] if k % 2 else ["blrg"], "press" if k % 2 else "farm") for k in range(600)]
    rows += [row(5000, 0, ["blrg"], "elsewhere"), row(5001, 1, ["zork"], "elsewhere"), row(5002, 0, ["word1"], "newbad"), row(5003, 1, ["word1"], "newgood")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(800)], "doc_id long, quality int")
    before, after = (quality.fit(d, labels, rounds=n) for n in (0, 2))
    assert min(after.given) > 500 and before.given == [0, 0]
    one, two = ({r["doc_id"]: r for r in quality.scored(d, m).where("doc_id >= 5000").collect()} for m in (before, after))
    # what the metadata view taught the text view, and the other way round
    assert two[5000]["text_score"] < 0.5 < two[5001]["text_score"] and two[5001]["text_score"] - two[5000]["text_score"] > one[5001]["text_score"] - one[5000]["text_score"] + 0.2
    assert two[5002]["metadata_score"] < 0.5 < two[5003]["metadata_score"] and abs(one[5002]["metadata_score"] - one[5003]["metadata_score"]) < 0.2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in found.fetchall())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = Workspace(spark, "t").save("a", corpus_pipeline.STAGES[0][1](spark, d, sf))
    kept = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert first.columns == d.columns and all(i in kept for i, q in labels.items() if q == 1)
    second = Workspace(spark, "t").save("b", corpus_pipeline.STAGES[1][1](spark, first, sf))
    third = Workspace(spark, "t").save("c", corpus_pipeline.STAGES[2][1](spark, second, sf))
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert sorted(r["doc_id"] for r in third.select("doc_id").collect()) == sorted({int(c) for _, _, c in brute_components(rows, 5, 80)})
    packed = corpus_pipeline.STAGES[3][1](spark, third, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in third.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.run(spark, sf).count() == packed.count()
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
