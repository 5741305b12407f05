"""Each operator against plain Python on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import components, decontamination, licenses, near_duplicates, packing, pii, preferences, quality, secrets, token_counts, token_files
from tracewell.llm.common import scratch
from tracewell.llm.shingling import shingle_sets
from tracewell.llm.tokenizing import BYTE_BPE, WORD_BPE, ChunkEncoder, encoder

rnd = random.Random(7)
WORDS = ["the", "of", "Anna", "thing", "réé", "onen", "stand", "x1", "über", "of", "and", "zeta", "k", "lorem", "ipsum"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


LONG = prose(9000, 1)
ODD = ["", " ", "\n\n", "a", "a b", None, "it's John's; we'll seé\t  x", "<|endoftext|> hi", "日本語 テキスト", "😀 emoji", "x" * 3000, LONG]


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(200, 2)
    near = base.split()
    near[50] = "changed"
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100, base), (101, base), (102, " ".join(near)), (103, base.upper()), (104, prose(200, 3)), (104, prose(30, 4)), (None, base), (None, None), (105, base), (105, base)]
    rows += [(200 + i, f"{prose(90, 50 + i)}\n{base}") for i in range(6)]
    return spark.createDataFrame([(a, b, "en", "s", 1, "w", "n", "extra") for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, n string, node string")


def collected(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("which", [WORD_BPE, BYTE_BPE])
def test_chunks_encode_as_the_whole_text(which):
    """Against the library's plain call, with nothing set on its tokenizer."""
    enc, plain = encoder(*which), Tokenizer.from_file(public_tokenizers.path(which[0]))
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "́", "'s", "'ll", "1", "23", ".", "!?", "\x1c", "\x85", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "ΑΣ", "日本", "​", "😀", "ſ", "K", "\xa0", "\r\n", "İ", "H̱"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + [t or "" for t in ODD] + ["hi <|endoftext|> there", "<|endoftext|><|endoftext|>x"]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_beyond_its_memory(monkeypatch):
    import tracewell.llm.tokenizing as t

    monkeypatch.setattr(t, "MOST_BYTES", 1 << 14)
    enc = ChunkEncoder(public_tokenizers.path(BYTE_BPE[0]), True)
    for i in [*range(6), *range(6)]:
        text = prose(60, i)
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc._ids(text)
        assert sum(t.ENTRY_BYTES + len(k) + len(v) for d in (enc.known, enc.known.before) for k, v in d.items()) <= 1 << 14


def test_token_files(spark, docs):
    path = scratch(spark, "t")
    token_files.write_token_files(docs, path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.start) for r in token_files.read_token_files(spark, path).collect()), key=lambda r: r[4])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(d is not None, d or 0, np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")) for d, t in collected(docs)]
    assert sorted((a, b, len(c), zlib.crc32(c.tobytes())) for a, b, c in want) == sorted(r[:4] for r in got)
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert [r[4] for r in got] == np.cumsum([0, *[r[2] for r in got]]).tolist()[:-1]
    assert sorted(token_files.read_document(spark, path, 104)) == sorted(c.tolist() for _, b, c in want if b == 104)
    empty = scratch(spark, "t")
    token_files.write_token_files(docs.limit(0), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    want = sorted(((d or -1), len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in collected(docs))
    pieces, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        pieces[r.doc_id or -1] += r.length
        sequences[r.sequence_id].append(r)
    totals = defaultdict(int)
    for d, n in want:
        totals[d] += n
    assert dict(pieces) == dict(totals)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    by_id = dict((d, t) for d, t in collected(docs) if d == 11)
    ids = np.array([*tok.encode(by_id[11], add_special_tokens=False).ids, 0], "<u4")
    for r in rows:
        if r.doc_id == 11:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_waits_for_no_more_than_its_window(spark):
    """Documents of one length, of which no two fill a sequence, and a hot one."""
    packer, enc = packing.Packer(1024, 0, 50), np.arange(600, dtype="<u4").tobytes()
    for i in range(2000):
        packer.add(i, enc)
        if packer.size >= 50:
            packer.pack(last=False)
        assert packer.size <= 50
    packer.pack(last=True)
    used = defaultdict(int)
    for _, _, n, _, _, sequence, _ in packer.rows:
        used[sequence] += n
    assert sum(used.values()) == 2000 * 600 and all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_fill_is_the_best_subset_sum():
    for _ in range(200):
        counts = {rnd.randint(1, 60): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(1, 120)
        got = packing.fill(counts, room)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * i for s in sums for i in range(c + 1) if s + k * i <= room}
        assert all(got[k] <= counts[k] for k in got) and sum(k * c for k, c in got.items()) == max(sums)


def test_token_counts_follow_edits(spark, docs):
    enc, plain = encoder(*BYTE_BPE), Tokenizer.from_file(public_tokenizers.path(BYTE_BPE[0]))
    for seed in range(60):
        r = random.Random(seed)
        text = r.choice([prose(r.randint(0, 900), seed), "x" * r.randint(0, 2000), " " * r.randint(0, 1500), LONG[: r.randint(0, 9000)]])
        tree = token_counts.build(enc, text)
        for _ in range(8):
            at, d, ins = r.randint(0, len(text) + 5), r.choice([0, 1, 3, 40, 700]), r.choice(["", " ", "a", " b c", "'s", "\n\n", prose(80, seed), "<|endoftext|>"])
            tree.edit(enc, at, d, ins)
            at = min(at, len(text))
            text = text[:at] + ins + text[at + d :]
            assert tree.count == len(plain.encode(text, add_special_tokens=False).ids), (seed, at, d, ins)
    edited = token_counts.with_edits(docs)
    want = []
    for row in edited.collect():
        text = row.text
        before = len(plain.encode(text, add_special_tokens=False).ids)
        for e in row.edits:
            text = text[: e["at"]] + e["inserted"] + text[e["at"] + e["n_deleted"] :]
        want.append((row.doc_id or -1, before, len(plain.encode(text, add_special_tokens=False).ids)))
    got = [(r.doc_id or -1, r.n_tokens, r.n_tokens_edited) for r in token_counts.count_with_edits(edited).collect()]
    assert sorted(got) == sorted(want)


def test_stored_trees_take_edits_without_encoding_the_text_again(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE[0]))
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    rows = [(1, LONG, [(100, 5, "new words"), (9000, 0, " x")]), (1, "a b", [(0, 9, "")]), (None, None, [(0, None, None)]), (2, "y" * 4000, None), (3, "", [(0, 0, "z z")])]
    docs = spark.createDataFrame([(*r, 5, ["l"]) for r in rows], "doc_id long, text string, edits array<struct<at:long,n_deleted:long,inserted:string>>, tokens int, leaves array<string>")
    path = scratch(spark, "trees")
    token_counts.build_trees(docs).write.parquet(path)
    edited = token_counts.apply_edits(spark.read.parquet(path)).collect()
    for row in edited:
        text, edits = next((t or "", e) for d, t, e in rows if d == row.doc_id and count(t or "") == row.n_tokens)
        for at, n, new in edits or []:
            text = text[:at] + (new or "") + text[at + (n or 0) :]
        assert "".join(row.leaves) == text and row.n_tokens_edited == count(text) == row.tokens[1] and row.chars[1] == len(text)
        assert row.n_chars_encoded <= 4 * 2 * token_counts.LEAF or len(text) < 5000
    again = spark.createDataFrame([(*r[:4], [(50, 3, "again")]) for r in edited], token_counts.TREES)
    assert sorted(r.n_tokens for r in token_counts.apply_edits(again).collect()) == sorted(r.n_tokens_edited for r in edited)
    assert token_counts.count_with_edits(docs.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "x mit license y Apache License, apache  license"), (3, None), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, "nothing of the kind " * 50), (7, licenses.TEMPLATES[12][1])]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].score, got[1].n_base, got[1].first_word) == ("mit", "mit", 1.0, 1, 3)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 6, "apache,mit")
    assert (got[3].n_words, got[3].first_word, got[3].score) == (0, None, 0.0)
    assert (got[4].base_labels, got[4].labels) == ("gpl", "gpl")
    assert (got[5].base_labels, got[5].labels) == ("", "cc-by-nc")
    assert (got[6].n_base, got[6].labels, got[6].n_words) == (0, "", 200)
    assert got[7].labels == "bsd" and got[7].score > 0.99


def test_every_license_of_a_notice_file_is_found():
    known = licenses.index()
    texts = [t for _, t, _ in licenses.all_templates()]
    notice = "\n\n".join([texts[2], texts[12], texts[13], texts[7], "Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0"])
    assert known.scan(licenses.words_of(notice))[2] == {"gpl", "lgpl", "mit", "bsd", "isc", "cc-by-nc", "cc-by-sa"}
    assert known.scan(licenses.words_of("\n".join(texts)))[2] == set(known.labels)
    for i in range(20):  # the best share is that of a search of all alignments
        words = licenses.words_of(" ".join(w for t in rnd.sample(texts, 6) for w in t.split() if rnd.random() < 0.85))
        shares = {}
        for t, own in enumerate(known.texts):
            if all(any(words[s : s + len(p)] == p for s in range(len(words))) for p in known.keys[t]):
                near = lambda d, q: own[q] in words[max(0, d + q - licenses.SLACK) : max(0, d + q + licenses.SLACK + 1)]  # noqa: B023, E731
                shares[t] = max(sum(known.idf[w] for q, w in enumerate(own) if near(d, q)) for d in range(-len(own) - 3, len(words) + 3)) / known.weight[t]
        found = known.scan(words)
        assert found[2] - found[1] == {known.labels[t] for t, x in shares.items() if x >= licenses.LEAST_SHARE} - found[1]
        assert found[3] == pytest.approx(min(1.0, max((x for x in shares.values() if x >= licenses.LEAST_SHARE), default=0.0)))


@pytest.mark.parametrize(("text", "labels"), [
    ("// SPDX-License-Identifier: AGPL-3.0-or-later", {"agpl"}), ("SPDX-License-Identifier: Zlib", {"zlib"}), ("under the European Union Public Licence (EUPL)", {"eupl"}), ("Distributed under the Boost Software License, Version 1.0.", {"boost"}),
    ("released as CC0 1.0 Universal", {"cc0"}), ("licensed under GNU GPL v3", {"gpl"}), ("an identifier of a license", set()), ("GNU is not a general licence", set()),
])
def test_names_and_tags_of_licenses(text, labels):
    assert licenses.index().scan(licenses.words_of(text))[2] == labels


def test_license_base_columns_against_plain_python(spark):
    r = random.Random(3)
    parts = ["MIT", "mit", "License", "license", "LICENSE", "Apache", "apache", "general", "General", "public", "Public", "x", "été", "l1cense", "license.license"]
    rows = [(i % 37 if i % 11 else None, r.choice([" ", "-", "\n", ", "]).join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, " ".join(r.choice(parts) for _ in range(60000)))]
    schema = "doc_id long, text string, labels int, n_words string, score string"
    got = sorted(str((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels)) for x in licenses.scan_licenses(spark.createDataFrame([(*x, 1, "a", "b") for x in rows], schema)).collect())
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want.append(str((doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))))
    assert got == sorted(want)
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).collect() == []


def regex_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_pii_base_equals_the_patterns():
    parts = ["a", "b.c", "@", "x@y.z", ".com", "1", "12", "255", "256", ".", "-", " ", "+", "+1 (743) 555-3824", "4111 1111 1111 1111", "10.0.0.1", "é", "000", "(", "%"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert pii.detect(text)[0] == regex_base(text), repr(text)


@pytest.mark.parametrize(("text", "hidden"), [
    ("mail john (at) example (dot) com now", "john (at) example (dot) com"), ("j.doe [at] ex.org", "j.doe [at] ex.org"),
    ("anna at mail dot example dot com please", "anna at mail dot example dot com"), ("jоhn@exаmple.com", "jоhn@exаmple.com"),
    ("call plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven"),
    ("write to jane at example.com.", "jane at example.com"), ("jane at example dot jp, please", "jane at example dot jp"), ("ring +1 555 one two three 4567 now", "+1 555 one two three 4567"),
    ("ring +1 555 one 234567", "+1 555 one 234567"), ("card 4111 one one one one 1111 1111 ok", "4111 one one one one 1111 1111"), ("j.k at mail dot example dot xyz", "j.k at mail dot example dot xyz"),
    ("１９２.１６８.0.1", "１９２.１６８.0.1"), ("jo​hn@example.com.", "jo​hn@example.com"),
])
def test_disguises(text, hidden):
    base, all_spans = pii.detect(text)
    assert hidden in [text[a:b] for _, a, b in all_spans]
    assert set(base) <= set(all_spans)
    assert hidden not in pii.redact(text, all_spans)


def test_trees_grow_with_their_texts():
    """Edits after a huge insertion encode a few leaves each, and so do appends to a document that began empty."""
    enc = encoder(*BYTE_BPE)
    tree = token_counts.build(enc, prose(40, 1))
    tree.edit(enc, 30, 0, " " + prose(30000, 2) + " ")
    once = tree.encoded
    for i in range(5):
        tree.edit(enc, 1000 * i, 1, "x")
    assert tree.encoded - once <= 5 * 4 * (token_counts.LEAF + 64) and max(map(len, tree.leaves)) < 2 * token_counts.LEAF
    grown = token_counts.build(enc, "")
    text = ""
    for i in range(200):
        more = f" {prose(5, i)}"
        grown.edit(enc, len(text), 0, more)
        text += more
    assert grown.text == text and grown.encoded <= 200 * 3 * (token_counts.LEAF + 64) and len([x for x in grown.leaves if x]) >= len(text) // (2 * token_counts.LEAF)
    for tree in (tree, grown):
        assert tree.count == len(enc.encode([tree.text])[0]) // 4 and tree.chars[1] == len(tree.text)
    r = random.Random(5)
    text = "x"
    tree = token_counts.build(enc, text)
    for i in range(150):
        at, n, new = r.randrange(len(text) + 1), r.choice([0, 0, 3, 900]), r.choice(["", "q", " w ", prose(r.choice([1, 60, 400]), i)])
        tree.edit(enc, at, n, new)
        text = text[:at] + new + text[at + n :]
    assert tree.text == text and tree.count == len(enc.encode([text])[0]) // 4


def test_pii_of_odd_and_long_texts(spark):
    for text in ["call ſix six six six six six six six", "𝟏𝟗𝟐.𝟏𝟔𝟖.0.1 😀 x", "one two three four"]:
        pii.detect(text)
    assert pii.detect("𝟏𝟗𝟐.𝟏𝟔𝟖.0.1")[1] == [("ip", 0, 11)]
    long = f"{LONG * 40} mail john (at) example (dot) com {'1' * 300_000} {'a' * 300_000} 10.0.0.1"
    base, every = pii.detect(long)
    at = long.index("john (at)")
    assert base == [("ip", len(long) - 8, len(long))] and every == [("email", at, at + len("john (at) example (dot) com")), *base]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string, n_ip string")).count() == 0


def test_pii_leaves_prose_alone(docs):
    for text in ["He looked at the dot on the wall at noon.", "one two buckle my shoe", "Version 1.2.3 of 2024", "It is sold at example.com and held at example.org.", "Look at the dot in it, at one dot in two.", "Contact us at example.com; looking at example.net", "room 5 one 2 three"]:
        assert pii.detect(text) == ([], [])
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count() and {r.base_sha256 for r in got if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    assert pii.redact_documents(docs).columns == docs.columns


def test_secret_ledger(spark):
    rows = [(1, 1, "token = abcdefghijkl"), (2, 1, "token = abcdefghijkl"), (3, 1, None), (3, 2, "AKIA" + "A" * 14), (None, 1, "token:secret:abcdefghijklmnopq deadbeefdeadbeef"), (5, 1, "clean")]
    ledger = scratch(spark, "ledger")
    one = spark.createDataFrame(rows, "path long, version int, text string")
    got = {(r.path, r.version): r for r in secrets.scan_versions(one, ledger).collect()}
    assert [tuple(x) for x in got[1, 1].found] == [(0, 0, 20)] == [tuple(x) for x in got[2, 1].found]
    assert got[3, 1].found is None and [tuple(x) for x in got[3, 2].found] == [(0, 1, 18)]
    assert [tuple(x) for x in got[None, 1].found] == [(31, 2, 47)]
    assert spark.read.parquet(ledger).count() == 5
    again = spark.createDataFrame([(9, 1, "token = abcdefghijkl"), (9, 2, "hex 0123456789abcdef")], one.schema)
    assert len(secrets.scan_versions(again, ledger).where("found IS NOT NULL").collect()) == 2
    assert spark.read.parquet(ledger).count() == 6
    secrets.scan_versions(again, ledger, "2").collect()
    assert spark.read.parquet(ledger).count() == 8


def plain_secrets(text):
    """The contract's base by the patterns as they are stated."""
    shapes = (("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16))
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(shapes) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def test_secrets_against_plain_python(spark):
    r = random.Random(11)
    parts = ["password", "Api_Key", "token", "TOKEN", "secret", "=", ":", " ", "\"", "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123", "x", "é", "😀", "\n", "-", "abcdefghijkl"]
    rows = [(i % 50 if i % 13 else None, "".join(r.choice(parts) for _ in range(r.randrange(16)))) for i in range(500)]
    rows += [(1, None), (2, ""), (3, "".join(r.choice(parts) for _ in range(40000)))]
    schema = "path long, text string, blob string, found int, kind int"
    versions = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], schema).withColumn("version", F.lit(1))
    out = secrets.digest(secrets.scan_versions(versions, scratch(spark, "ledger")))
    base = [(i, plain_secrets(t or "")) for i, t in rows]
    want = sorted(str((i, *[sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(b).encode()).hexdigest())) for i, b in base)
    assert sorted(str((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256)) for x in out.collect()) == want and sum(len(b) for _, b in base) > 200
    assert secrets.digest(secrets.scan_versions(versions.limit(0), scratch(spark, "ledger"))).collect() == []


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    more = docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(900, "a b c d e f g " * 9, "z"), (901, "l one\nl one\n\n\nl two #$", "z")], "doc_id long, text string, words string"))
    got = sorted(tuple(-1 if v is None else v for v in r[:6]) for r in quality.quality(more).collect())
    assert got == sorted(((-1 if d is None else d), *brute_quality(t)) for d, t in collected(more))
    assert quality.quality(docs.limit(0)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.quality(docs).where("kept").count() > 0


def brute_sets(rows):
    out = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((-1 if d is None else d), len(s), (low.get(find(i), -1) if s else (-1 if d is None else d))) for i, (d, s) in enumerate(sets))


def test_shingle_sets_have_the_right_sizes():
    import pyarrow as pa

    texts = [t or "" for t in ODD] + [prose(40, i) for i in range(5)]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(s) for _, s in brute_sets([(0, t) for t in texts])]


def test_a_run_of_any_length_is_one_word(spark, monkeypatch):
    import pyarrow as pa

    import tracewell.llm.shingling as shingling

    run = "".join(rnd.choices("abcXYZ0189+/é", k=600_000))
    texts = [run, f"a b {run} c d", f" {run} {LONG} {run}", run * 5, run * 5 + "x", f"{run * 2} {run * 2}", "x" * shingling.PIECE, "x" * shingling.PIECE + " y", "x" * shingling.PIECE + "y "]
    sets = shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(s) for _, s in brute_sets([(0, t) for t in texts])]
    assert not set(sets[3].tolist()) & set(sets[4].tolist())
    short = [prose(rnd.randint(0, 60), i) + rnd.choice(["", " ", "\n", "y" * rnd.randint(1, 300)]) for i in range(50)] + [t or "" for t in ODD]
    whole = [s.tolist() for s in shingle_sets(pa.array(short))]
    for piece in (7, 16, 61):
        monkeypatch.setattr(shingling, "PIECE", piece)
        assert [s.tolist() for s in shingle_sets(pa.array(short))] == whole
    monkeypatch.undo()
    rows = [(1, run * 5), (2, run * 5 + "x"), (3, (run * 5).replace("X", "x")), (4, f"{LONG} {run}"), (5, f"{LONG} {run}z")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates.near_duplicates(made).collect()) == brute_components(rows)


def test_near_duplicates(spark, docs, monkeypatch):
    got = sorted(tuple(-1 if v is None else v for v in r) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == brute_components(collected(docs))
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    base = prose(120, 9).split()
    rows = []
    for i in range(60):  # a chain of edits: neighbours link, ends do not
        base = list(base)
        base[rnd.randrange(120)] = f"edit{i}"
        base[rnd.randrange(120)] = f"mark{i}"
        rows.append((i, " ".join(base)))
    for i in range(60, 110):  # copies with two or three edits of one text: some link, most do not quite
        own = prose(100, 10).split()
        for at in rnd.sample(range(100), rnd.choice([1, 2, 3])):
            own[at] = f"own{i}at{at}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_duplicates, "RUN", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    monkeypatch.setattr(near_duplicates, "AT_ONCE", 0)
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates.near_duplicates(made).collect()) == brute_components(rows)


@pytest.mark.parametrize("run", [2, 24])
def test_groups_of_one_prefix_are_expanded(spark, monkeypatch, run):
    """Sets of one size and prefix that differ in what is common everywhere: some link, some do not."""
    lines = [" ".join(f"common{i}word{j}" for j in range(12)) for i in range(8)]
    rows = []
    for text in range(3):
        head = " ".join(f"head{text}x{j}" for j in range(70))
        for i in range(30):
            rows.append((len(rows), "\n".join([head, *rnd.sample(lines, 2 if text else 1), ".", "end of it"])))
    rows += [(1000 + i, f"{lines[i % 8]} {prose(30, 900 + i)}") for i in range(400)]
    assert len({s for _, s in brute_sets(rows[:90])}) > 40
    monkeypatch.setattr(near_duplicates, "RUN", run)
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates.near_duplicates(made).collect()) == brute_components(rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    r = random.Random(3)
    edges = [tuple(f"{x:04d}" for x in (r.randrange(300), r.randrange(300))) for _ in range(140)] + [(f"{i:04d}", f"{i + 1:04d}") for i in range(500, 540)]
    root = {}
    for a, b in edges:
        for x in (a, b) if a != b else ():
            root.setdefault(x, x)
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert sorted(map(tuple, got)) == sorted(root.items())
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_decontamination_of_hits_far_apart(spark):
    """Shared shingles at both ends of a long text, windows at its very end, columns of clashing names; against the SQL."""
    item = prose(30, 500)
    rows = [(1, f"{item[:60]} {LONG} {item[-60:]}"), (2, f"{LONG} {item}"), (3, f"{item} {item} {LONG} {item} x {item}"), (4, " ".join(item.split()[1:])), (5, " ".join(item.split()[:26])), (6, "")]
    docs = spark.createDataFrame([(a, b, "n", 1, "w") for a, b in rows], "doc_id long, text string, n string, k int, w string")
    items = spark.createDataFrame([(7, item, 1, "have"), (8, prose(30, 501), 1, "r")], "item_id long, text string, k int, have string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(r.item_id, r.text) for r in items.collect()])
    want = con.sql(decontamination.oracle())
    got = decontamination.contaminated(docs, items).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and {r.doc_id for r in got} == {2, 3, 4, 5}


def test_decontamination(spark):
    item = prose(40, 11)
    items = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "w " * 30), (5, item)], "item_id long, text string")
    near = item.split()
    near[39] = "other"
    rows = [(1, f"{prose(50, 12)} {item.upper()}, {prose(10, 13)}"), (2, f"{prose(500, 14)} {' '.join(near)} {prose(70, 15)}"), (3, prose(100, 16)), (4, "a Short item, here b"), (5, None), (6, f"{prose(9, 17)} {' '.join(item.split()[:15])} {prose(30, 18)}"), (7, "x " + "w " * 35), (None, item)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, round(r.similarity, 6)) for r in decontamination.contaminated(made, items).collect())
    assert got == sorted([(1, 1, 1.0), (1, 5, 1.0), (2, 1, round(35 / 37, 6)), (2, 5, round(35 / 37, 6)), (4, 2, 1.0), (7, 4, 1.0), (-1, 1, 1.0), (-1, 5, 1.0)])
    assert decontamination.contaminated(made.limit(0), items).count() == 0
    assert decontamination.contaminated(made, items.limit(0)).count() == 0
    few = decontamination.MOST_IN_SET
    decontamination.MOST_IN_SET = 3
    try:
        assert sorted((r.doc_id or -1, r.item_id, round(r.similarity, 6)) for r in decontamination.contaminated(made, items).collect()) == got
    finally:
        decontamination.MOST_IN_SET = few


def test_radius_finds_similar_windows(spark):
    """Of windows with 0.8 to 0.9 of their shingles shared, nearly all are within the radius."""
    item = [f"i{k}" for k in range(54)]
    rows = []
    for d in range(300):
        own = list(item)
        own[rnd.choice([0, 1, 2, 3])] = f"d{d}"
        own[rnd.choice([50, 51, 52, 53])] = f"e{d}"
        rows.append((d, " ".join(own)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.contaminated(made, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count()
    assert found >= 0.99 * sum(1 for _, t in rows if similarity(t.split(), item) >= 0.8)


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good <|im_end|>"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "q"), (3, "chosen", 0, "user", "q"), (3, "rejected", 0, "user", "q"), (None, "rejected", None, None, None),
    ]
    got = {r.pair_id: r for r in preferences.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).collect()}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.chosen == "<|im_start|>assistant\ngood < |im_end|><|im_end|>\n"
    a, b = map(int, one.rejected_mask.split(":"))
    assert (one.prompt + one.rejected)[a:b] == one.rejected
    assert got[2].n_common == 0 and got[2].rejected == "" and got[2].prompt == ""
    assert got[3].n_common == 1 and got[3].chosen == got[3].rejected == ""
    assert got[None].rejected.startswith("<|im_start|>\n")


def test_pairs_of_conversations(spark):
    """Against the SQL: repeated last turns, null ids and texts, an empty table, columns of clashing names."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (2, None, "assistant", "x <|im_end|>"), (2, 5, "assistant", "zz"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (5, 2, None, "only"), (None, 0, "user", "q"), (None, 1, "user", "q")]
    made = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, side string, back int")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(preferences.oracle())
    got = preferences.preferences(preferences.pairs_of(made))
    key = lambda r: repr(r)
    known = [r for r in want.fetchall() if r[0] is not None]  # the SQL joins on the id, so it has no row for a null one
    assert sorted((tuple(r) for r in got.select(*want.columns).collect() if r.pair_id is not None), key=key) == sorted(known, key=key)
    by_id = {r.pair_id: r for r in got.collect()}
    assert by_id[1].n_common == 2 and by_id[3].n_common == 0 and set(by_id) == {1, 2, 3, 5, None}
    assert preferences.preferences(preferences.pairs_of(made.limit(0))).count() == 0


def test_sql_agrees(spark, tmp_path, docs):
    """The SQL of operators that have it, on the odd rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = con.sql(quality.oracle())
    names = rows.columns
    key = lambda r: repr(r)
    assert sorted(rows.fetchall(), key=key) == sorted((tuple(r) for r in quality.quality(docs).select(*names).collect()), key=key)


def test_pipeline_stages_of_nothing_and_of_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, prose(40, 77))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = prose(200, 5)
    docs = spark.createDataFrame([(1, text, 7, "a"), (2, text, 8, "b"), (3, prose(200, 6), 9, "c")], "doc_id long, text string, row_number_of_stage long, node string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    near = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and sorted((r.doc_id, r.row_number_of_stage) for r in near.collect()) == [(1, 7), (3, 9)]
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r.row_number_of_stage for r in left.collect()) == [7, 8, 9]
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    base = [prose(150, 100 + i) + " the of and der die das" for i in range(6)]
    leak = prose(30, 300)
    texts = [base[0], base[0], base[1], f"{base[2]} {leak}", f"{base[3]} mail a@b.com", "too few words", base[4], None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = {i for i, t in enumerate(texts) if t and brute_quality(t)[0] >= 10}
    assert good == {0, 1, 2, 3, 4, 6}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 2, 4, 6}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_tokens for r in rows if r.doc_id == 4} == {len(tok.encode(f"{base[3]} mail <EMAIL>").ids) + 1}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns


def test_stages_tell_rows_without_an_id_of_their_own_apart(spark, tmp_path):
    leak, clean = prose(30, 300), [prose(150, 400 + i) for i in range(4)]
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, clean[0]), (1, clean[0]), (None, clean[0]), (None, clean[1]), (None, clean[1]), (2, clean[2]), (2, f"{clean[3]} {leak}"), (None, f"x {leak}"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] or -1, r[1] or "")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    want = [(1, clean[0]), (None, clean[1]), *rows[5:]]
    assert sorted(map(tuple, near.collect()), key=key) == sorted(want, key=key)
    left = corpus_pipeline.decontamination_stage(spark, near, str(tmp_path))
    assert sorted(map(tuple, left.collect()), key=key) == sorted([(1, clean[0]), (None, clean[1]), (2, clean[2]), (3, None), (3, None)], key=key)
