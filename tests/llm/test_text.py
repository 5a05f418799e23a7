"""The text operators on small tables with odd rows, against plain versions."""

import re
import sys
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from subsumer.llm import licenses, line_quality, mixing, near_dups, pieces, token_blocks, toxicity
from subsumer.llm.common import running_sum, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _x string"


def docs_of(spark, rows):
    """rows: (doc_id, text, source), with columns whose names clash."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "x") for i, t, s in rows], SCHEMA)


WORDS = "all rights reserved cc by the general public license apache under version alpha beta gamma delta".split()


def odd_rows(n=40):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 40))), f"s{i % 4}") for i in range(n)]
    rows += [(100, None, "s0"), (101, "", None), (102, "  \n ", "s1"), (None, "no id cc by", "s1"), (103, "tie", "s2"), (103, "tie", "s2"), (104, "word " * 3000, "s3"), (105, "Ünïcode K İ ▁ \x1c cc-by", "S")]
    return rows


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(300)], "k long, v long")
    got = {r["k"]: r["s"] for r in running_sum(df, ["k"], "v", "s").collect()}
    assert got == {i: sum(j % 5 for j in range(i)) for i in range(300)}
    assert running_sum(df.limit(0), ["k"], "v", "s").count() == 0


def test_mix(spark):
    rows = odd_rows()
    out = mixing.mix_sources(docs_of(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = {}
    for i, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted((s for s in total if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        cut = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not cut:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in cut}
        open_ -= cut
    taken = {}
    for r in out:
        assert r["size"] == size(r["text"]) and r["source_size"] == total[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in order) and len(out) == len(rows)
    assert mixing.mix_sources(docs_of(spark, rows).limit(0)).count() == 0


def test_token_blocks(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(file)
    rows = odd_rows()
    path = scratch_path(spark, "ids")
    token_blocks.write_ids(docs_of(spark, rows), path, tokenizer=file, end_id=2)
    got = token_blocks.with_starts(token_blocks.read_ids(spark, path)).orderBy("start").collect()
    wanted, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == wanted
    path = scratch_path(spark, "ids")
    token_blocks.write_ids(docs_of(spark, rows).limit(0), path, tokenizer=file, end_id=2)
    assert token_blocks.with_starts(token_blocks.read_ids(spark, path)).count() == 0


def test_words_have_the_ids_that_the_library_gives_texts():
    encoder = token_blocks.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    texts = [" ".join(f"a{c}, {c}b!{c}" for c in chars[at : at + 100]) for at in range(0, len(chars), 100)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|endof text|>", "<a> x<|", " \x85\u2003\x1c ", "क़, x\u0301 \u0301y"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    # what is kept comes back the same
    assert encoder.encode(texts[-9:]) == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[-9:]]


def test_words_are_learned_together(monkeypatch):
    encoder = token_blocks.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words, calls, learned = [f"{a}{b}{c}{m}" for a in ("Éa", "ba", "ThE") for b in ("in", "ou") for c in map(chr, range(97, 123)) for m in ("", ",", "###", ").")], [], []
    sys.setprofile(lambda frame, event, what: calls.append(what) if event == "c_call" else None)
    try:
        ids = encoder.encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words) / 4  # not one or more a word
    assert np.frombuffer(ids[0], "<u4").tolist() == encoder.library.encode(" ".join(words), add_special_tokens=False).ids
    # words of the latest texts stay when there are too many
    monkeypatch.setattr(token_blocks, "CACHE", 10)
    monkeypatch.setattr(encoder, "_learn", lambda missing: learned.extend(missing))
    assert encoder.encode([" ".join(words)]) == ids and not learned


def test_words_of_known_parts_are_not_learned(monkeypatch):
    encoder = token_blocks.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    learned, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda missing, *more: (learned.extend(missing), learn(missing, *more)))
    encoder.encode(["Éabc, def.) ghi"])
    assert len(learned) == len({*learned})
    del learned[:]
    text = "éABC.) DEF,\x0cGhi def \n\n gHi, ÉABC ghi.)"
    assert encoder.encode([text, "", " "]) == [np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b"", b""]
    assert not learned
    # white space that is not ASCII is left to the library
    odd = ["a\x1cb \x1f", "\u2003", "x\x85Y\u3000'll \x00"]
    assert encoder.encode(odd) == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_tokens_that_go_on_behind_spaces_are_refused():
    with pytest.raises(ValueError):
        token_blocks.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_blocks_hold_any_ids():
    rng = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 5000):
        for top in (1, 3, 1 << 15, 1 << 20, (1 << 32) - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.integers(0, n)] = (1 << 32) - 1  # an exception
            starts, body = token_blocks.encode_blocks(ids)
            assert (token_blocks.decode_blocks(starts, body, n) == ids).all()
            assert (token_blocks.read_range(starts, body, n // 3, n) == ids[n // 3 :]).all()


def test_licenses(spark):
    rows = [*odd_rows(), (200, "Licensed under the Apache License, Version 2.0.", "s"), (201, "licensed under the very Apache license version 2 0", "s")]
    got = licenses.license_labels(licenses.license_spans(docs_of(spark, rows))).collect()
    wanted = []
    for i, t, _ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        wanted.append((i, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    key = lambda rs: sorted(map(str, rs))
    assert key(tuple(r)[:6] for r in got) == key(wanted)
    by = {r["doc_id"]: r for r in got}
    assert by[200]["labels"] == "apache-2.0" and by[200]["score"] == 1.0
    assert by[201]["labels"] == "apache-2.0"  # a word put in: two neighbouring diagonals
    assert licenses.license_spans(docs_of(spark, rows).limit(0)).count() == 0


def plain_labels(words, scan=licenses.Scan()):
    """What votes on diagonals, merged and verified word by word, find in a text."""
    found = []
    for _, phrase, label, template in scan.templates():
        k = scan.phrase_words if phrase else scan.notice_words
        votes = {}
        for i in range(len(words) - k + 1):
            for j in range(len(template) - k + 1):
                if words[i : i + k] == template[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        spans = []
        for d in sorted(votes):
            if spans and not phrase and d - spans[-1][-1] <= scan.gap:
                spans[-1].append(d)
            else:
                spans.append([d])
        for span in spans:
            hit = len(set().union(*(votes[d] for d in span)))
            there = [i for i, w in enumerate(template) if any(0 <= d + i < len(words) and words[d + i] == w for d in span)]
            if hit >= (1 if phrase else scan.votes) * (len(template) - k + 1) and len(there) >= (1 if phrase else scan.least) * len(template):
                found.append((phrase, label, min(span) + there[0], max(span) + there[-1] + 1, len(there) / len(template)))
    better = lambda s: any(not o[0] and o[4] > s[4] and o[2] < s[3] and s[2] < o[3] for o in found)
    return {s for s in found if s[0] or s[4] == 1 or not better(s)}


def test_license_texts_of_any_length(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i, (body, _) in enumerate((*licenses.BODIES, *licenses.NOTICES)):
        words = body.split()
        edited = [w if rng.random() > 0.03 else f"{w} more" for w in words]
        rows += [(10 * i, f"Start: {body}.\n{body}", "s"), (10 * i + 1, " ".join(edited).upper(), "s"), (10 * i + 2, " ".join(words[: len(words) // 2]), "s"), (10 * i + 3, " ".join(rng.permutation(words)), "s")]
    got = {r["doc_id"]: {(s["phrase"], s["label"], s["start"], s["end"], s["coverage"]) for s in r["spans"]} for r in licenses.license_spans(docs_of(spark, rows)).collect()}
    assert got == {i: plain_labels(re.findall("[a-z0-9]+", text.lower())) for i, text, _ in rows}
    for i, (_, label) in enumerate(licenses.BODIES):
        assert label in {s[1] for s in got[10 * i]} and label in {s[1] for s in got[10 * i + 1]}
        assert all(s[1] != label or s[3] - s[2] < 60 for s in got[10 * i + 2])  # half a text is at most a notice


def near_rows():
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base), "s"), (2, " ".join(base).upper(), "s"), (7, " ".join(base), "s")]
    for i in range(10, 40):
        copy = list(base)
        for k in rng.choice(60, rng.integers(1, 4), replace=False):
            copy[k] = f"x{i}{k}"
        rows.append((i, " ".join(copy), "s"))
    return rows + [(50, "one two", "s"), (51, "One  two", "s"), (52, None, "s"), (53, "", "s"), (None, " ".join(base), "s"), (54, " ".join(f"v{k}" for k in range(30)), "s")]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = near_rows()
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    group = {i: i for i in sets if i is not None}
    for _ in group:
        for a in group:
            for b in group:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = near_dups.near_duplicates(docs_of(spark, rows), near_dups.Near(words=words)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(s), group.get(i), i is not None and group[i] == i) for i, s in sets.items()
    }
    assert near_dups.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_prefixes_of_a_document_with_two_texts(spark):
    near = near_dups.Near(words=4)
    long = [f"w{k}" for k in range(200)]
    texts = [(1, " ".join(f"v{k}" for k in range(20)), "s"), (1, " ".join(long), "s"), (2, " ".join([*long[:-1], "x"]), "s")]
    sets = near_dups.shingles_of(docs_of(spark, texts), spark.createDataFrame([(1,), (2,)], "doc_id long"), near)
    classes = spark.createDataFrame([(1, 17, 1), (1, 197, 1), (2, 197, 2)], "rep long, n long, component long")
    assert [tuple(r) for r in near_dups.prefix_pairs(classes, sets, near).collect()] == [(1, 2)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["id"]: r["component"] for r in near_dups.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_sketches_fill_and_estimate():
    a = near_dups.shingle_set(" ".join(f"a{i}" for i in range(400)), 1)
    b = near_dups.shingle_set(" ".join(f"a{i}" for i in range(80, 400)), 1)
    one, two = near_dups.sketch(a, 192, 1), near_dups.sketch(b, 192, 1)
    assert abs((one == two).mean() - 0.8) < 0.12
    assert len(near_dups.sketch(a[:1], 192, 1)) == 192


def test_pieces(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t or "" for _, t, _ in odd_rows()] + [" ", "a  b ", "\n\n x\n", "日本語", " a", "tab\there\r\n"]
    plain = pieces.Codec(pieces.Dropout(model, dropout=0.0))
    for t in texts:
        ids = np.frombuffer(plain.encode([t], [1])[0], "<u4")
        assert plain.decode(ids) == t.encode()
        if pieces.MARK not in t:
            assert ids.tolist() == library.encode(t)
    settings = pieces.Dropout(model)
    df = docs_of(spark, odd_rows()).select("doc_id", "text", pieces.encoded(settings, F.col("doc_id"), F.col("text")).alias("ids"))
    got = df.withColumn("back", pieces.decoded(settings, F.col("ids"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert sum(len(r["ids"]) for r in got) > sum(len(library.encode(r["text"] or "")) for r in got)
    again = {str((r["doc_id"], r["ids"])) for r in pieces.encoded_rows(settings, docs_of(spark, odd_rows())).collect()}
    assert again == {str((r["doc_id"], r["ids"])) for r in got}


def test_query_returns_ids(spark, tmp_path):
    from subsumer.llm import entry

    docs_of(spark, odd_rows()).drop("size", "_x").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.op7_merge_dropout(spark, str(tmp_path)).collect()
    codec = pieces.Codec(pieces.Dropout(public_tokenizers.path("piece_bpe_32k.model")))
    wanted = [(i, np.frombuffer(codec.encode([t or ""], [i or 0])[0], "<i4").tolist()) for i, t, _ in odd_rows()]
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["ids"])) for r in got)
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in got)


def test_every_occurrence_draws_for_itself(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    codec, plain = pieces.Codec(pieces.Dropout(model)), pieces.Codec(pieces.Dropout(model, dropout=0.0))
    words = ["international", "▁x", "the", "w" * 80] * 1000
    drawn = [codec.word(w, int(k)) for w, k in zip(words, codec.keys_of(len(words), 1), strict=True)]
    assert len(set(drawn[::4])) > 20 and len(set(drawn[2::4])) > 1
    text = " ".join(words)
    first, second, other = codec.encode([text] * 3, [1, 1, 2], [0, 1, 0])
    assert first == b"".join(drawn) and len({first, second, other}) == 3
    # one merge is skipped as often as the setting says
    pair = next(w for w in ("a", "b", "x") if plain.ids.get("▁" + w) is not None)
    split = sum(codec.word(pair, int(k)) != plain.word(pair, 0) for k in codec.keys_of(10_000, 3))
    assert abs(split / 10_000 - 0.1) < 0.02
    rows = docs_of(spark, [(1, text, "s")]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    got = pieces.encoded_rows(pieces.Dropout(model), rows, F.col("copy")).collect()
    assert len({str(r["ids"]) for r in got}) == 3


def labelled(spark, n=240):
    rng = np.random.default_rng(9)
    prose = ["river", "stone", "walks", "under", "green", "evening", "quiet", "lantern"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(prose, 30))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            words[5] = "prefix" + rng.choice(["idiot", "scum"]) + "ish"
        text = " ".join(words[:15]) + "\n" + " ".join(words[15:])
        rows.append((i, text if good else text.upper().replace(" ", "!! ") + "\n***$$$ " * 3, "s"))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "river", "s"), (1002, "stone " * 60_000, "s")]
    return docs_of(spark, rows), spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.toxicity_score(model, docs).alias("s")).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert max(none.scores(["idiot", ""])) < 1e-6


def test_long_texts_have_the_same_ngrams(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = set(toxicity.ngrams(text, np.zeros(toxicity.SIZE, np.int32)).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert set(toxicity.ngrams(text, np.zeros(toxicity.SIZE, np.int32)).tolist()) == whole


def test_packed_ids_come_back():
    rng = np.random.default_rng(4)
    rows = [np.zeros(0, np.int32), np.array([0], np.int32), np.array([254, 255, 510, 0, toxicity.SIZE - 1], np.int32)]
    rows += [rng.choice(toxicity.SIZE, n, replace=False).astype(np.int32) for n in (1, 50, 5000)]
    ids, row = toxicity._flat(pd.DataFrame({"ids": [toxicity.packed(x) for x in rows]}))
    assert all(ids[row == i].tolist() == sorted(x.tolist()) for i, x in enumerate(rows))


def test_weights_are_those_of_a_plain_fit(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    rows = [(r["text"], known[r["doc_id"]]) for r in docs.collect() if r["text"] is not None and r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    places = np.zeros(toxicity.SIZE, np.int32)
    x, y = [np.unique(toxicity.ngrams(t, places)) for t, _ in rows], np.array([v for _, v in rows], float)
    p, q = np.ones(toxicity.SIZE), np.ones(toxicity.SIZE)
    for own, v in zip(x, y, strict=True):
        (p if v else q)[own] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[p + q - 2 < toxicity.LEAST_DOCS] = 0
    assert (model.weights[ratio == 0] == 0).all()
    own = np.where(y > 0, toxicity.WEIGHT * len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    # the gradient of the penalised loss is near 0 where the fit ended
    used = np.flatnonzero(ratio)
    z = np.zeros(toxicity.SIZE)
    z[used] = model.weights[used] / ratio[used]
    raw = np.array([(z * ratio)[i].sum() for i in x]) + model.bias
    error = own * (1 / (1 + np.exp(-raw)) - y) / len(y)
    gradient = toxicity.PENALTY * z
    for e, i in zip(error, x, strict=True):
        gradient[i] += e * ratio[i]
    start = np.abs(sum(o * (0.5 - v) / len(y) * np.bincount(i, minlength=toxicity.SIZE) for o, v, i in zip(own, y, x, strict=True)) * ratio).max()
    assert np.abs(gradient).max() < 0.02 * start


def test_quality(spark):
    docs, labels = labelled(spark)
    model = line_quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", line_quality.quality_score(model, docs).alias("s")).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert line_quality.fit_quality(docs, labels.limit(0)).scores(["x"])[0] == 0.5


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    per_text = np.array([4, 1, 3])
    evidence, stay = rng.normal(size=8), 0.7
    odds, same = line_quality.marginals(evidence, per_text, stay)
    at = 0
    for n in per_text:
        weights = {}
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(e * v for e, v in zip(evidence[at : at + n], y)) + stay * sum(a == b for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        for k in range(n):
            assert 1 / (1 + np.exp(-odds[at + k])) == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for k in range(n - 1):
            assert same[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k] == y[k + 1]) / z)
        at += n


def test_license_plans_have_no_python(spark):
    found = licenses.license_labels(licenses.license_spans(docs_of(spark, odd_rows(5))))
    grams, templates = licenses._template_tables(spark, licenses.Scan())
    for df in (grams, templates, found.select(*[c for c in found.columns if c != "doc_id"])):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan.replace("PythonSQLMetrics", "") and "Arrow" not in plan and "applySchema" not in plan
