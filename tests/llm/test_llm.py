"""Operators of the llm subpackage against brute force, on a small table of hard cases and on the smallest test tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, language_model, licenses, neighbours, pii, quality, sharding, simhash, token_counts
from sparkloom.operators import graph

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, score double, `n_words` bigint, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts():
    r = random.Random(5)
    some = [
        None, "", " ", "\n\t", "one", "One two", "a@b.co", "x y z " * 40, "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559!",
        "call +1 (302) 555-0171 or +44 20 7946 0958; not +1 22", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.255 v1.2.3", "a@b.co_x@d.com foo@bar@baz.org é@ü.de 日本a@b.c.d",
        "MIT License mit license, Apache  License; CC BY-NC 4.0 and the GNU General Public License, version 3.", "spdx-license-identifier: Apache-2.0",
        "naïve café 日本語 😀 text", "é É ß İ     \x1c \x85 end", "a" * 3000, "1" * 3000, "#" * 2000, "<|endoftext|> is text <|startoftext|>",
        " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x1"]) for _ in range(3000)), "token " * 5 + "\x00 nul",
    ]
    return some


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1.5, 7, 3) for i, t in enumerate(texts())]
    rows += [(3, "One two", "en", 0.0, 7, 3), (3, "One two", "en", 0.0, 7, 3), (None, "x y z " * 40, None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# 1 ----------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (kind, e) in enumerate(kinds):
        for m in re.finditer(e, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base(spark, docs, small):
    for df in (docs, small):
        got = pii.extract(df.select("doc_id", "text", F.col("text").alias("spans")), keep=["doc_id", "text"]).collect()
        assert len(got) == df.count()
        for r in got:
            assert [(b.start, b.rank, b.end, b.kind) for b in r.base] == base_spans(r.text), r.text
            assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii.extract(empty(spark)).count() == 0


@pytest.mark.parametrize("sent", [200_000, 0])
def test_pii_bootstrap(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "SENT_BACK", sent)
    rows = [(i, f"customer reference user{i}@mail.com confirmed today") for i in range(30)] + [(100, "customer reference joe19876543 confirmed today"), (101, "plain 987654 number"), (102, None)]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.extract(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[100] == [("email", "joe19876543")] and got[101] == [] and got[102] == [] and len(got[5]) == 1
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert clean[100] == "customer reference <email> confirmed today" and clean[101] == rows[31][1] and clean[102] is None


def test_pii_bootstrap_grows(spark):
    """Accepted instances induce patterns that no seed has, and groups of digits joined by spaces or brackets are candidates."""
    rows = [f"customer reference user{i}@mail.com confirmed today" for i in range(60)]
    found = [f"acct{i}98765" for i in range(12)]
    rows += [f"customer reference {x} confirmed today" for x in found] + [f"billing handle {x} archived yesterday" for x in found]
    rows += ["billing handle zoe4455667 archived yesterday", "plain zed4455667 number"]  # the first only beside what was discovered
    rows += [f"dial +1 302 555 {1000 + i} promptly" for i in range(30)] + ["dial 555 123 4567 promptly", "dial (302) 555 0171 promptly", "dial 123 45 6789 promptly", "plain 444 123 4567 number"]
    got = {r.text: [(s.kind, s.value) for s in r.spans] for r in pii.extract(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    assert all(got[f"billing handle {x} archived yesterday"] == [("email", x)] for x in found)
    assert got["billing handle zoe4455667 archived yesterday"] == [("email", "zoe4455667")]
    for x in ("555 123 4567", "(302) 555 0171", "123 45 6789"):
        assert got[f"dial {x} promptly"] == [("phone", x)]
    assert got["plain zed4455667 number"] == [] and got["plain 444 123 4567 number"] == []


SPACE = r"[ \t\n\x0b\f\r]"
WORD_ = rf"(?:[\p{{L}}\p{{N}}]++|(?!{SPACE})[^\p{{L}}\p{{N}}])"


def plain_matches(text, core, barred):
    """(start, end, word before, word after) of leftmost matches that don't overlap; one begins where the last ended or not behind a barred character."""
    import regex

    core, out, last = regex.compile(core), [], 0
    s = 0
    while s <= len(text):
        m = core.match(text, s) if s == last or not s or not regex.match(barred, text[s - 1]) else None
        if not m or m.end() == s:
            s += 1
            continue
        before = regex.search(rf"(?<![\p{{L}}\p{{N}}])({WORD_}){SPACE}*+$", text[last:s])
        out.append((s, m.end(), before[1] if before else "", regex.match(rf"{SPACE}*+({WORD_}?+)", text[m.end() :])[1]))
        last = s = m.end()
    return out


def plain_bootstrap(texts_):
    """Spans of every text by plain loops: the base's matches, the candidates, the graph and its rounds."""
    cores = {"email": (r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]"), "ip": (r"[0-9]++(?:\.[0-9]++){3}", "[0-9]"), "card": (r"[0-9](?:[\x20-]?[0-9])++", "(?!)"), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "(?!)")}
    base, free, edges = [], [], {}
    for t in texts_:
        valid = {(a, b) for a, _, b, _ in base_spans(t)}
        own = [(a, list(cores).index(kind), b, kind, w, x) for kind, (core, barred) in cores.items() for a, b, w, x in plain_matches(t, core, barred) if (a, list(cores).index(kind), b, kind) in base_spans(t)]
        assert {(a, b) for a, _, b, *_ in own} == valid
        some = [m for m in plain_matches(t, r"[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+", r"[A-Za-z0-9._%+@-]") if sum(c in "0123456789" for c in t[m[0] : m[1]]) >= 5 or "@" in t[m[0] : m[1]]]
        some += [m for m in plain_matches(t, r"\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++", "[A-Za-z0-9]") if sum(c in "0123456789" for c in t[m[0] : m[1]]) >= 5 and re.search("[ ()]", t[m[0] : m[1]])]
        some = [m for m in some if not any(a < m[1] and b > m[0] for a, _, b, *_ in own)]
        base.append(sorted(own))
        free.append(some)
        for a, _, b, kind, w, x in own:
            for q in plain_patterns(w, x):
                edges[q, t[a:b].lower()] = max(kind, edges.get((q, t[a:b].lower())) or "")
        for a, b, w, x in some:
            for q in plain_patterns(w, x):
                edges.setdefault((q, t[a:b].lower()), None)
    size = Counter(q for q, _ in edges)
    edges = {e: kind for e, kind in edges.items() if size[e[0]] >= pii.CONFIDENT * (size[e[0]] + 1)}
    scores, before = {}, -1
    for _ in range(pii.ROUNDS):
        mass, sure = Counter(), set()
        for (q, _), kind in edges.items():
            if kind:
                mass[q, kind] += 1
                sure.add((q, kind))
        for (q, i), kind in edges.items():
            for k in cores:
                if not kind and (i, k) in scores:
                    mass[q, k] += scores[i, k]
                    if round(scores[i, k], 9) >= pii.ACCEPT:
                        sure.add((q, k))
        confidence = {x: mass[x] / (size[x[0]] + 1) for x in sure if mass[x] / (size[x[0]] + 1) >= pii.CONFIDENT}
        wrong = {}
        for (q, i), kind in edges.items():
            for k in cores:
                if not kind and (q, k) in confidence:
                    wrong[i, k] = wrong.get((i, k), 1.0) * max(1 - confidence[q, k], 1e-9)
        scores = {x: 1 - v for x, v in wrong.items()}
        now = sum(round(v, 9) >= pii.ACCEPT for v in scores.values())
        if now == before:
            break
        before = now
    best = {}
    for (i, k), v in scores.items():
        if round(v, 9) >= pii.ACCEPT:
            best[i] = max(best.get(i, (-1, 0)), (round(v, 9), -list(cores).index(k)))
    out = []
    for t, own, some in zip(texts_, base, free, strict=True):
        got = [(a, b, -best[t[a:b].lower()][1]) for a, b, *_ in some if t[a:b].lower() in best]
        got = [(a, r, b, list(cores)[r]) for a, b, r in got if not any(c < b and d > a and d - c > b - a for c, d, _ in got)]
        out.append(sorted([x[:4] for x in own] + got))
    return out


def plain_patterns(before, after):
    left, right = (re.sub("[0-9]", "0", x.lower()) for x in (before, after))
    return [q for q, there in ((f"L {left}", left), (f"R {right}", right), (f"B {left} {right}", left and right)) if there]


def test_pii_against_plain_loops(spark, small):
    r = random.Random(9)
    names = ["mail", "write to", "server", "card no", "dial", "id", "ref:", "kontakt", "(", "\u00e9crire"]
    values = [lambda: f"u{r.randrange(99)}@x{r.randrange(9)}.org", lambda: ".".join(str(r.randrange(300)) for _ in range(4)), lambda: "4111 1111 1111 1111", lambda: f"+1 302 555 0{r.randrange(100, 999)}", lambda: f"ab{r.randrange(10**5, 10**6)}", lambda: f"{r.randrange(100, 999)} 555 {r.randrange(1000, 9999)}", lambda: f"(302) 555 0{r.randrange(100, 999)}", lambda: f"user{r.randrange(50)}@local"]
    made = []
    for k, kind in enumerate(names[:6]):
        made += [f"{kind} {values[k % 4]()} please, now" for _ in range(40)] + [f"{kind} {r.choice(values)()} please" for _ in range(4)]
    made += [" ".join(f"{r.choice(names)} {r.choice(values)()} {r.choice(['ok', 'please', ';', '12'])}" for _ in range(6)) for _ in range(60)] + texts()[1:]
    for rows in (made, [x.text or "" for x in small.collect()]):
        df = spark.createDataFrame(list(enumerate(rows)), "k int, text string").repartition(3)
        got = {x.k: [(s_.start, s_.rank, s_.end, s_.kind) for s_ in x.spans] for x in pii.extract(df, keep=["k"]).collect()}
        want = plain_bootstrap(rows)
        assert [got[k] for k in range(len(rows))] == want
        if rows is made:
            assert sum(map(len, want)) > sum(len(base_spans(t)) for t in rows) + 10


def test_pii_clashes_and_redaction(spark):
    names = ["free", "seen", "extra", "spans", "base", "row", "head", "body", "kind", "instance", "pattern", "rank"]
    texts_ = [None, "", "a@b.co", "to a@b.co, 1.2.3.4 and 4111 1111 1111 1111; +1 (302) 555-0171!", "日本 a@b.co 😀 c@d.org", "no", "x@y.com" * 3]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts_, texts_[3]])], "doc_id int, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    found = pii.extract(df)
    assert [c for c in found.columns if c not in ("base", "spans")] == ["doc_id", "text", *(c for c in names if c not in ("base", "spans"))]
    clean = pii.redact(df)
    assert clean.columns == df.columns and all([x[c] for c in names] == list(range(len(names))) for x in clean.collect())
    spans = {x.doc_id: x.spans for x in found.collect()}
    for x in df.collect():
        want, end = "", 0
        for s_ in spans[x.doc_id]:
            if s_.start >= end:
                want += x.text[end : s_.start] + f"<{s_.kind}>"
            end = max(end, s_.end)
        got = next(y.text for y in clean.collect() if y.doc_id == x.doc_id)
        assert got == (None if x.text is None else want + x.text[end:])
    assert pii.redact(df.limit(0)).count() == 0


def test_pii_of_many_matches_and_long_words(spark):
    """20,000 matches in a text, and a neighbouring word of 100,000 characters: whole, and in time near proportional to the text."""
    import time

    began, long = time.perf_counter(), "w" * 100_000
    rows = [(0, "to a@b.co or 1.2.3.4; " * 10_000), (1, f"{long} 192.168.0.1 {long} a@b.co"), (2, "1.2.3.4," * 5_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in pii.extract(df, keep=["doc_id"]).collect()}
    assert len(got[0].base) == 20_000 and got[0].base[-1].start == 22 * 9_999 + 13 and len(got[1].base) == 2 and len(got[2].base) == 5_000
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "to <email> or <ip>; " * 10_000 and clean[1] == f"{long} <ip> {long} <email>" and clean[2] == "<ip>," * 5_000
    assert time.perf_counter() - began < 120


# 2 and 6 ----------------------------------------------------------------------------------------------------------


def test_bpe(spark, docs, small):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, small):
        got = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN, outputs=("ids", "starts", "ends", "ids_sha256", "decoded_sha256")), path, public_tokenizers.PATTERN).collect()
        assert len(got) == df.count()
        for r in got:
            t = r.text or ""
            assert r.ids == own.encode_ordinary(t) and bytes(r.decoded) == t.encode()
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
            covered = set()
            for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
                assert own.decode_single_token_bytes(i) in t[a:b].encode()
                covered |= set(range(a, b))
            assert len(covered) == len(t)
    assert bpe.encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_periodic_runs():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, mine, r = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.codec(path, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        t = r.choice(["a", " ", "-", "=", "aba", "\n", "0", "ha", "  \n", "<>"]) * r.randint(1, 200) + r.choice(["", "x", " \t"])
        assert mine.encode_batch([t]) == [own.encode_ordinary(t)]


def test_tokenizers_keep_to_the_workers_thread():
    """Threads of the library's own wait and use up time beside as many workers as cores."""
    import os
    import subprocess
    import sys

    code = """if True:
        import os, public_tokenizers, pyarrow as pa
        from sparkloom.llm import bpe, token_counts
        bpe_path, count_path = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}x{k}" for i in range(2000)) for k in range(4)])], names=["t"])
        for run in (bpe._encoder(bpe_path, public_tokenizers.PATTERN, ("n_tokens",)), token_counts._counter(count_path, 32_768, 256)):
            before = len(os.listdir("/proc/self/task"))
            assert sum(x.num_rows for x in run([batch])) == 4
            print(len(os.listdir("/proc/self/task")) - before)
    """
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True, timeout=300).stdout.split() == ["0", "0"]


def test_token_counts(spark, docs, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for df, chunk in ((docs, 32_768), (small, 32_768), (docs, 100), (small, 700)):
        got = token_counts.count_tokens(df, path, keep=["doc_id", "text"], chunk=chunk, overlap=20).collect()
        assert len(got) == df.count()
        for r in got:
            assert r.n_tokens == len(own.encode(r.text or "", add_special_tokens=False)), r.text
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def encoded_by(own):
    def encode(part):
        found = own.encode(part, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]

    return encode


def test_boundaries_are_proven():
    """What stands on either side of a boundary is encoded alike alone and together."""
    own, r = token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json"))[0], random.Random(3)
    parts = ["'s", "'t", "it's", "'", "''", "!", "!'ll", "e\u0301", "\u0301", "7", "42", "é", "日本語", "。", "、", "İ", "Σ", "한국", "\u1112\u1161\u11ab", "x", "abc", " ", "\n", "\u3000", "\x1c", "-", "+/=", "<|endoftext|>", "<|start", "|>", "ß", "١", "ⅷ", "²", "q", "re", "\u09c7\u09be", "\u212b"]
    count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(2, 40)))
        special = [range(m.start() + 1, m.end()) for m in re.finditer(r"<\|(?:start|end)oftext\|>", text)]
        for p in token_counts.boundaries(text, 0, len(text)):
            if not any(p in inside for inside in special):  # margins keep boundaries out of these
                assert count(text[:p]) + count(text[p:]) == count(text), (text, p)


@pytest.mark.parametrize("kind", ["base64", "cjk", "letters", "special", "mixed"])
def test_long_texts_without_space(kind):
    """Texts without white space are spliced too, in time in proportion to their length."""
    import time

    own, r = token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json"))[0], random.Random(8)
    made = {
        "base64": lambda n: base64.b64encode(r.randbytes(n * 3 // 4)).decode(),
        "cjk": lambda n: "".join(r.choice("的一是不了人我在有他这中大来上国个到说们") if r.random() < 0.93 else r.choice("。，") for _ in range(n)),
        "letters": lambda n: "".join(r.choice("abcdefgh") for _ in range(n)),
        "special": lambda n: ("ab12<|endoftext|>cd,34<|startoftext|>" * n)[:n],
        "mixed": lambda n: "".join(r.choice(["abc", "!", "日本", "12", "'s", "é", "e\u0301", "-"]) for _ in range(n // 2)),
    }[kind]
    small_ = made(60_000)
    for chunk, overlap in ((32_768, 256), (700, 40)):
        assert token_counts.count_long(small_, encoded_by(own), chunk, overlap, 17) == len(own.encode(small_, add_special_tokens=False).ids)
    if kind in ("base64", "cjk"):
        big, began = made(1_000_000), time.perf_counter()
        assert token_counts.count_long(big, encoded_by(own), margin=17) == sum(len(own.encode(x, add_special_tokens=False).ids) for x in re.findall(r"[0-9。，]|[^0-9。，]+", big)) or kind == "base64"
        assert time.perf_counter() - began < 60


# 3 ----------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, small):
    for df in (docs, small):
        got = licenses.scan_licenses(df.select("doc_id", "text")).collect()
        assert len(got) == df.count()
        for r in got:
            words = WORD.findall(lower(r.text))
            places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
            assert r.n_words == len(words) and [(p.word, p.label) for p in r.places] == places, r.text
            assert {label for _, label in places} <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert len(licenses.rules()) > 300


def test_license_suppression(spark):
    text = "SPDX-License-Identifier: LGPL-2.1-only. This is under the GNU Lesser General Public License, version 3. Licensed under CC BY-NC 4.0."
    (r,) = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()
    assert r.labels == ["cc-by", "cc-by-nc", "lgpl"]  # cc-by is the base's
    spans = [(d.start, d.end) for d in r.detections]
    assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)


def written(expression, optional):
    """A text that an expression of the rules matches: first alternatives, with or without the optional parts."""
    left = re.sub(r"\[(.)[^]]*\](?:[+*]|\{([0-9]+)[0-9,]*\})?", lambda m: ("7" if m[1] == "0" else m[1]) * max(1, int(m[2] or 1)), expression)
    left = re.sub(r"([a-z ])\?", lambda m: m[1] if optional else "", left)
    while m := re.search(r"\(\?:([^()]*)\)(\??)", left):
        left = left[: m.start()] + ("" if m[2] and not optional else m[1].split("|")[0]) + left[m.end() :]
    return left.strip()


def test_license_rules_fire_alone(spark):
    """Every rule finds the text that is made from its own expression alone, whatever else its family is called."""
    rules = licenses.rules()
    rows = [(k, written(e[6:-5], optional)) for k, (_, e, *_) in enumerate(rules) for optional in (False, True)]
    for k, text in rows:
        assert re.search(rules[k][1], f" {text} "), (rules[k], text)
    df = spark.createDataFrame(rows, "k int, text string").withColumn("norm", licenses.spaced_words(F.col("text")))
    missed = [(rules[r.k], r.text) for r in df.select("k", "text", licenses._detections(F.col("norm")).alias("d")).collect() if not any((d.label, d.priority) == rules[r.k][2:4] for d in r.d)]
    assert not missed
    texts_ = {"SPDX-License-Identifier: EPL-2.0": "epl", "https://opensource.org/licenses/CDDL-1.0": "cddl", "scripts.sil.org/OFL": "ofl", "mariadb.com/bsl": "busl", "All advertising materials mentioning features or use of this software": "bsd-4-clause"}
    got = licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts_], "text string")).collect()
    assert {r.text: r.labels for r in got} == {t: [label] for t, label in texts_.items()}
    texts_ = {"Attribution-NonCommercial 4.0 International": "cc-by-nc", "Unauthorized copying of this file, via any medium, is strictly prohibited": "proprietary", "* Redistributions of source code must retain": "bsd", "You should have received a copy of the GNU General Public License along with this program": "gpl"}
    got = {r.text: r.labels for r in licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts_], "text string")).collect()}
    assert all(label in got[t] for t, label in texts_.items())


def test_license_text_of_many_detections(spark):
    """20,000 detections in a text: places and suppression take time near proportional to their number."""
    import time

    text, began = "mit license, see GPL; " * 20_000, time.perf_counter()
    (r,) = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()
    assert len(r.places) == 20_000 and r.places[-1].word == 4 * 19_999 and {"mit", "gpl"} <= set(r.labels)
    starts = [d.start for d in r.detections]
    assert starts == sorted(starts) and len(starts) >= 20_000 and time.perf_counter() - began < 60


def test_running_values(spark):
    from sparkloom.llm import common

    r = random.Random(1)
    rows = [(k, [r.randint(0, 9) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 127, 128, 129, 256, 257, 5000))]
    for x in spark.createDataFrame(rows, "k int, v array<int>").select("v", common.running_totals(F.col("v")).alias("t"), common.running_greatest(F.col("v")).alias("g")).collect():
        assert x.t == [sum(x.v[:i]) for i in range(len(x.v))] and x.g == [max(x.v[:i], default=-1) for i in range(len(x.v))]


# 4 ----------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, n=10):
    words, hit, ids = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    ids.add(str(item))
    return len(words), hit, sorted(ids)


@pytest.mark.parametrize("limit", [4_000_000, 3])
def test_decontamination(spark, limit):
    r = random.Random(2)
    draw = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(1, draw(14)), (2, "Short, ITEM"), (3, ""), (4, None), (5, draw(14)), (11, "short item")]
    long = items[0][1]
    rows = [(i, t) for i, t in enumerate([None, "", "x", "a short item here", long + " tail " + long, draw(4000), "pre; " + items[4][1].upper() + "!", long[:17]])] + [(4, "a short item here"), (None, "short item")]
    docs_, bench = spark.createDataFrame(rows, "doc_id int, text string").repartition(2), spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.scan(docs_.withColumn("whole", F.col("text")), bench, set_gates=limit).collect()
    assert len(got) == len(rows)
    for row in got:
        n, hit, ids = brute_hits(row.whole, items)
        assert (row.n_words, row.n_hit, row["items"]) == (n, len(hit), ids), row
        assert {w for s in row.hits for w in range(s.start, s.end)} == hit
    kept = Counter((x.doc_id, x.text) for x in decontaminate.remove_documents(docs_, bench, set_gates=limit).collect())
    assert kept == Counter((i, t) for i, t in rows if not brute_hits(t, items)[1])
    cleaned = {x.doc_id: x.text for x in decontaminate.remove_spans(docs_, bench, set_gates=limit).where("doc_id in (0, 2, 3, 6)").collect()}
    assert cleaned == {0: None, 2: "x", 3: "a here", 6: "pre!"}
    assert decontaminate.scan(docs_.limit(0), bench).count() == 0
    assert decontaminate.scan(docs_, bench.limit(0)).where("n_hit = 0").count() == len(rows)
    assert decontaminate.remove_documents(docs_.limit(0), bench, set_gates=limit).count() == 0 and decontaminate.remove_documents(docs_, bench.limit(0), set_gates=limit).count() == len(rows)
    names = ["ids", "words", "hash", "gate", "head", "w", "p", "row", "k1", "key_", "hits_", "spans", "len", "at"]
    clash = docs_.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)], F.lit("z").alias("HITS"))
    found = decontaminate.scan(clash, bench, set_gates=limit)
    assert found.columns == ["doc_id", *names, "n_words", "n_hit", "hits", "items"] and all(x["gate"] == 3 for x in found.collect()) and found.count() == len(rows)
    kept = decontaminate.remove_documents(clash, bench, set_gates=limit)
    assert kept.columns == clash.columns and Counter((x.doc_id, x.text) for x in kept.collect()) == Counter((i, t) for i, t in rows if not brute_hits(t, items)[1])
    assert decontaminate.remove_spans(clash, bench, set_gates=limit).columns == clash.columns


@pytest.mark.parametrize("limit", [4_000_000, 70_000])
def test_decontamination_by_a_large_benchmark(spark, limit):
    """200,000 windows, as one set and in shards: the same plan as for a small one."""
    r = random.Random(12)
    item = lambda: " ".join(str(r.randrange(10**6)) for _ in range(1009))
    items = [(k, item()) for k in range(200)]
    cuts = {k: (r.randrange(990), r.randrange(200)) for k in range(300)}
    rows = [(k, f"{item()[:2000]} " + (" ".join(items[i][1].split()[a : a + 12 if k % 3 else a + 9]) if k % 2 else "") + " tail") for k, (a, i) in cuts.items()]
    got = {x.doc_id: (x.n_hit, x["items"]) for x in decontaminate.scan(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string"), set_gates=limit).collect()}
    assert got == {k: (12, [str(i)]) if k % 2 and k % 3 else (0, []) for k, (_, i) in cuts.items()}


# 5 ----------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(docs_, labels)
    held = docs_.join(labels, "doc_id").where(quality.crc_mod(F.col("doc_id"), 3) == 1).select("doc_id", "text", "quality")
    got = quality.classify(held, net).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in got]) >= 0.9
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.95
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "x"), (None, "y" * 200_000)], "doc_id int, text string")
    scores = [r.score for r in quality.classify(odd, net).collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    assert quality.classify(odd.limit(0), net).count() == 0
    assert 0 < quality.score(quality.fit([], []), "x") < 1


def test_quality_score_by_loops():
    """A score is what plain loops over the chunks' places give."""
    net, r = quality.Network.fresh(3), random.Random(4)
    net.offset = 0.3
    for text in (None, "", "x", "héllo", "".join(r.choice("abc é日\n") for _ in range(1500))):
        raw = (text or "").encode()
        raw = raw + b"\0" * (quality.WIDTH if not raw else quality.WIDTH - 1)
        places, chunks, begin = len(raw) - quality.WIDTH + 1, [], 0
        while True:
            own = range(begin, min(places, begin + quality.CHUNK))
            chunks.append([math.tanh(max(sum(float(net.filters[j][raw[i + j]][f]) for j in range(quality.WIDTH)) for i in own) + float(net.bias[f])) for f in range(quality.FILTERS)])
            if begin + quality.CHUNK >= places:
                break
            begin += quality.CHUNK - quality.OVERLAP
        z = net.offset + sum(float(net.mean[f]) * sum(c[f] for c in chunks) / len(chunks) + float(net.peak[f]) * max(c[f] for c in chunks) for f in range(quality.FILTERS))
        assert quality.score(net, text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_keep_good(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    clash = docs.withColumns({"QUALITY_SCORE_": F.lit(1), "quality": F.lit("q"), "hash": F.lit("h")})
    kept = quality.keep_good(clash, labels)
    net = quality.train(clash, labels)
    assert kept.columns == clash.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter((x.doc_id, x.text) for x in clash.collect() if quality.score(net, x.text) >= 0.5)
    assert quality.keep_good(clash.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_quality_sample(spark):
    docs_ = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'z' AS hash", "0 AS quality")
    again = docs_.where("doc_id = 5").selectExpr("doc_id", "'a' AS text", "hash", "quality", "explode(sequence(1, 500))").drop("col")
    odd = spark.createDataFrame([(None, "null id", "z", 0), (6, None, "z", 0), (7, "long" * 9, "z", 0)], "doc_id bigint, text string, hash string, quality int")
    docs_ = docs_.where("doc_id NOT IN (6, 7)").union(again).union(odd)
    labels = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 9 THEN NULL ELSE cast(id % 2 AS int) END AS quality", "1 AS toxic")
    every = quality.sample_of(docs_, labels, rows=5000, most_bytes=20)
    want = {i: "text %d" % i for i in range(3000) if i % 10 != 9 and zlib.crc32(str(i).encode()) % 3 != 1 and i != 7}
    want.update({k: v for k, v in {5: "a", 6: None}.items() if k in want})
    assert {r.doc_id: r.text for r in every} == want and len(every) == len(want)
    assert all(r.quality == r.doc_id % 2 for r in every)
    for n in (1, 3, 40):
        assert quality.sample_of(docs_, labels, rows=n, most_bytes=20) == every[:n]
    assert quality.sample_of(docs_.limit(0), labels) == []


def test_most_frequent(spark):
    rows = [(f"w{i}{c}", n) for i in range(300) for c, n in (("", 1 + i % 7), ("é", 1 + i * i % 1000))]
    counted = spark.createDataFrame(rows, "word string, c bigint").repartition(5)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for n in (1, 2, 77, 599, 600, 1000):
        assert [tuple(r) for r in language_model.most_frequent(counted, n)] == want[:n]
    assert language_model.most_frequent(counted.limit(0), 5) == []


def test_chunks_cover():
    for n in (1, 15, 16, 17, 511, 512, 513, 1007, 1008, 1009, 5000):
        s = quality.starts_of(n)
        assert s[0] == 0 and s[-1] + quality.CHUNK >= n and all(b - a == quality.CHUNK - quality.OVERLAP for a, b in zip(s, s[1:], strict=False))
    net = quality.Network.fresh()
    codes = quality.codes_of("é" * 3000)
    assert np.allclose(quality.pooled(net, codes).max(axis=0), net.responses(codes).max(axis=0))


# 7 ----------------------------------------------------------------------------------------------------------------


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def same_groups(a, b):
    left, right = defaultdict(set), defaultdict(set)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[x].add(i)
        right[y].add(i)
    return {frozenset(s) for s in left.values()} == {frozenset(s) for s in right.values()}


def test_simhash(spark, docs, small):
    for df in (docs, small):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted(((r.doc_id is None, r.doc_id, r.fingerprint), r.component_id) for r in simhash.near_duplicates(df).collect())
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, f"{brute_print(r[1]):016x}"))
        got = sorted(got, key=lambda g: (g[0][0], g[0][1] or 0, g[0][2]))
        prints = [brute_print(t) for _, t in rows]
        assert [f"{p:016x}" for p in prints] == [g[0][2] for g in got]
        roots = brute_components(prints)
        least = {k: min((rows[i][0] for i in range(len(rows)) if roots[i] == k and rows[i][0] is not None), default=None) for k in set(roots)}
        assert [least[k] for k in roots] == [g[1] for g in got]
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("pairs_", "wide"), [(16_384, 10**9), (0, 10**9), (16_384, 0), (0, 0)])
def test_links_of_fingerprints(spark, monkeypatch, pairs_, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:120]:
        for k in range(1, 8):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), k)))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "PAIRS", pairs_)
    monkeypatch.setattr(simhash, "CELL", 3)
    monkeypatch.setattr(graph, "LEAST_HOT", 64 if pairs_ else 2)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    got = {int(np.int64(x.fp).astype(np.uint64)): x.root for x in simhash.component_of(df).collect()}
    assert same_groups([got[p] for p in prints], brute_components(prints))


def test_anchors_are_never_broadcast(spark):
    found = simhash.links(spark.range(500).select((F.col("id") * 7).alias("fp")))
    found.collect()
    at, seen = None, 0
    for line in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines():
        depth = re.search(r"[^\s:+|-]", line + "x").start()
        if at is not None and depth <= at:
            at = None
        if "BroadcastExchange" in line:
            at = depth
        seen += "SortMergeJoin" in line
        assert at is None or "Generate explode" not in line
    assert seen >= 4


def test_simhash_of_hot_copies(spark):
    word = lambda k: f"w{k}"
    text = " ".join(map(word, range(400)))
    rows = [(k, text) for k in range(900, 1000)] + [(k, f"{text} {word(k)}") for k in range(500, 600)] + [(k, f"other text {k} " * 9) for k in range(3)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    least = {k: min(r[0] for r, q in zip(rows, roots, strict=True) if q == k) for k in set(roots)}
    assert got == {r[0]: (f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, roots, strict=True)}
    assert Counter(c for _, c in got.values()).most_common(1)[0][1] >= 100


@pytest.mark.parametrize(("bits", "segments", "apart"), [(21, 1, 1), (22, 1, 1), (32, 2, 2)])
def test_anchors_cover(bits, segments, apart):
    r = random.Random(6)
    for _ in range(60):
        x = r.getrandbits(bits)
        own = simhash.anchors_of(x, bits, segments, apart)
        assert len(set(own)) == len(own) and not any(simhash.syndrome(a, segments) for a in own) and (own[0] ^ x).bit_count() <= segments
        for _ in range(60):
            y = x ^ sum(1 << b for b in r.sample(range(bits), r.randint(0, apart)))
            assert own[0] in simhash.anchors_of(y, bits, segments, apart)


def test_keep_one(spark, docs):
    rows = docs.collect()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    roots = brute_components([brute_print(r.text) for r in rows])
    best = {}
    for r, k in zip(rows, roots, strict=True):
        best[k] = min(best.get(k, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(best.values())


# 8 ----------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = {i: r.normal(size=16).round(2).tolist() for i in range(400)}
    v |= {i: v[3] for i in range(400, 440)} | {440: None, 441: [0.0] * 16, 442: [float("nan")] * 16, 443: [None] + [1.0] * 15, 460: [1e-3] * 16, 480: [float("inf")] * 16, 500: [1.0, 2.0]}
    again = [(1, [9.0] * 16), (1, [8.0] * 16), (20, [7.0] * 16), (7, v[7])]  # ids that repeat, with other vectors and with the same
    given = [*v.items(), *again]
    good = neighbours.usable(spark.createDataFrame([*given, (None, v[1])], "vec_id bigint, embedding array<float>"))
    got = defaultdict(list)
    for x in neighbours.nearest(good, good.where("vec_id % 20 = 0"), query_block=7, candidate_block=50).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    ok = [(i, np.float32(x).astype(float)) for i, x in given if x and None not in x and np.isfinite(x).all() and any(x)]
    want = defaultdict(list)
    for n, (q, y) in enumerate(ok):
        if q % 20 == 0:
            scores = []
            for m, (i, x) in enumerate(ok):
                if n != m and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(y.tolist(), x.tolist(), strict=True):
                        s += a * b
                    scores.append((-s, i))
            want[q] += [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:20])]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert len(got[20]) == 40
    assert neighbours.nearest(good.limit(0), good.limit(0)).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------


def brute_markov(rows, held, own, classes, states, rounds):
    """Scores by a plain Baum-Welch: dense, a text and a token at a time, in double precision."""
    learned = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    p0 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    head = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w.encode()))[:own]
    symbol = lambda w: 0 if w is None else 1 + head.index(w) if w in head else 1 + own + zlib.crc32(w.encode()) % classes
    kinds = Counter(symbol(w) for w in c)
    m = language_model.Model.fresh(1 + own + classes, states)
    start, move, of = m.start, m.move, lambda w: m.ratio[symbol(w)]

    def posteriors(t):
        alpha, beta, scales = [], [np.ones(states)], []
        for k, w in enumerate(t):
            a = (start if k == 0 else alpha[-1] @ move) * of(w)
            scales.append(a.sum())
            alpha.append(a / a.sum())
        for w, z in zip(t[:0:-1], scales[:0:-1], strict=True):
            beta.append(move @ (of(w) * beta[-1]) / z)
        beta.reverse()
        xi = (np.outer(a, of(w) * b) * move / z for a, w, b, z in zip(alpha, t[1:], beta[1:], scales[1:], strict=False))
        return sum(map(math.log10, scales)), [a * b for a, b in zip(alpha, beta, strict=True)], sum(xi, np.zeros((states, states)))

    for _ in range(rounds):
        begun, moved, grid, exact = np.zeros(states), np.zeros((states, states)), defaultdict(lambda: np.zeros(states)), defaultdict(lambda: np.zeros(states))
        for t in learned:
            _, gamma, xi = posteriors(t)
            begun, moved = begun + gamma[0], moved + xi
            for w, g in zip(t, gamma, strict=True):
                grid[symbol(w)] += g
                exact[w] += g
        share = sum(grid.values()) / n
        start, move = (begun + 0.1 / states) / (begun + 0.1 / states).sum(), (moved + 0.1 / states) / (moved + 0.1 / states).sum(axis=1, keepdims=True)
        table_ = {s: (g / share + 0.5 * kinds[s]) / (g.sum() + 0.5 * kinds[s]) for s, g in grid.items()}
        of = lambda w: table_.get(symbol(w), np.ones(states))
    last = {w: (g / share + 0.5) / (c[w] + 0.5) for w, g in exact.items()}
    of = lambda w: last.get(w, np.ones(states))
    unseen = sum(last[w] * p0(w) for w in c) + p0(object())
    assert np.allclose(unseen, 1)  # each state's emissions sum to one
    return [posteriors(t)[0] + sum(math.log10(p0(w)) for w in t) for _, t in rows]


def tokens_of(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]


def test_language_model(spark, docs, small, monkeypatch):
    """Base and score against plain loops; most words are beyond the frequent ones, and few texts fit into a block or a piece."""
    own, classes, states = 40, 16, language_model.STATES
    for name, value in (("OWN", own), ("CLASSES", classes), ("SYMBOLS", 1 + own + classes), ("BLOCK", 400), ("COUNTED", 50)):
        monkeypatch.setattr(language_model, name, value)
    monkeypatch.setattr(language_model.Model.fresh.__func__, "__defaults__", (1 + own + classes, states, language_model.SEED))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for df in (docs.where("length(text) < 500 OR text IS NULL"), small.orderBy("doc_id").limit(25)):
        rows = [(r.doc_id, tokens_of(r.text)) for r in df.select("doc_id", "text").collect()]
        c = Counter(w for i, t in rows if not held(i) for w in t)
        n, v = sum(c.values()), len(c)
        base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want = sorted((i is None, i or 0, held(i), len(t), sum(c[w] > 0 for w in t), n, base(t), s) for (i, t), s in zip(rows, brute_markov(rows, [held(i) for i, _ in rows], own, classes, states, 4), strict=True))
        clash = df.select("doc_id", "text", *[F.lit(k).alias(x) for k, x in enumerate(("known", "base", "syms", "rest", "inside", "block", "words", "docs", "e0", "SCORE"))])
        found = language_model.score_texts(clash.withColumn("h", language_model.crc_mod(F.col("doc_id"), 5) == 1), ~F.col("h"), rounds=4)
        assert found.columns[2:11] == ["known", "base", "syms", "rest", "inside", "block", "words", "docs", "e0"]
        got = sorted((r.doc_id is None, r.doc_id or 0, r.h, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect())
        assert [g[:6] for g in got] == [w[:6] for w in want]
        assert np.allclose([g[6:] for g in got], [w[6:] for w in want], rtol=2e-3, atol=2e-3)
    none = language_model.score_texts(docs, F.lit(False), keep=["doc_id"]).collect()
    assert len(none) == docs.count() and all(r.n_known == r.train_tokens == r.base_score == 0 and abs(r.score) < 1e-9 for r in none)
    assert language_model.score_texts(empty(spark), F.lit(True)).count() == 0


def test_language_model_beats_its_base(spark):
    """On texts held out, by 0.3 in log10 a token: rounds go on until they gain little."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language_model.crc_mod(F.col("doc_id"), 5) == 1)
    r = language_model.score_texts(docs_, ~F.col("held"), keep=["held"]).where("held").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    assert r.s >= r.b + 0.3


@pytest.mark.parametrize("piece", [100, 4, 1])
def test_markov_recursions(monkeypatch, piece):
    """Likelihoods and expected counts against all paths, for whole texts and for texts in pieces; a round of Baum-Welch never lowers the likelihood."""
    from itertools import product

    monkeypatch.setattr(language_model, "SCALE", 3)
    r, states = np.random.default_rng(1), 3
    m = language_model.Model.fresh(9, states, 5)
    seqs = [r.integers(0, 9, n) for n in (5, 3, 3, 1, 7)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    got, counts, found = language_model.likelihoods(m, flat, lengths, piece), language_model.Counts.zero(9, states), np.zeros((len(flat), states))
    for places, gamma in language_model.expected(m, flat, lengths, counts, piece):
        found[places] = gamma
        language_model.add_to(counts.grid, flat[places], gamma)
    moves, gammas = np.zeros((states, states)), []
    for s, log in zip(seqs, got, strict=True):
        total, gamma, moved = 0.0, np.zeros((len(s), states)), np.zeros((states, states))
        for path in product(range(states), repeat=len(s)):
            p = m.start[path[0]] * m.ratio[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.ratio[x, b]
            total += p
            gamma[range(len(s)), path] += p
            for a, b in zip(path, path[1:], strict=False):
                moved[a, b] += p
        assert math.isclose(10**log, total, rel_tol=1e-9)
        moves += moved / total
        gammas.append(gamma / total)
    assert np.allclose(found, np.concatenate(gammas)) and np.allclose(counts.move, moves) and counts.tokens == len(flat) and math.isclose(counts.log, got.sum())
    assert math.isclose(counts.start.sum(), len(seqs)) and np.allclose(counts.grid.sum(axis=1), np.bincount(flat, minlength=9))
    assert language_model.likelihoods(counts.model(np.ones(9)), flat, lengths, piece).sum() > got.sum()


def test_markov_of_long_texts():
    """A text of 300,000 tokens gives what its tokens give one after another, in bounded time."""
    import time

    r = np.random.default_rng(2)
    m, codes, began = language_model.Model.fresh(50, 4, 3), np.random.default_rng(3).integers(0, 50, 300_000), time.perf_counter()
    counts = language_model.Counts.zero(50, 4)
    (log,) = language_model.likelihoods(m, codes, np.array([len(codes)]))
    for places, gamma in language_model.expected(m, codes, np.array([len(codes)]), counts):
        language_model.add_to(counts.grid, codes[places], gamma)
    assert time.perf_counter() - began < 30
    a, want = m.start, 0.0
    for k, x in enumerate(codes):
        a = (a if k == 0 else a @ m.move) * m.ratio[x]
        want += math.log10(a.sum())
        a = a / a.sum()
    assert math.isclose(log, want, rel_tol=1e-9) and math.isclose(counts.log, want, rel_tol=1e-9) and np.allclose(counts.grid.sum(axis=1), np.bincount(codes)) and r is not None


# 10 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, small):
    for df in (docs, small):
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        got = sharding.shard_by_bytes(df, 5).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        slots, sizes = defaultdict(list), Counter()
        for r in got:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        total, largest = sum(sizes.values()), max(k[1] for k in want)
        assert all(abs(s - total / 5) <= 2 * largest for s in sizes.values())
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


# The queries ------------------------------------------------------------------------------------------------------


def test_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    d, queries = "/root/testdata/sf0.001", __spark_entry__.queries()
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    for name in (n for n in queries if re.match(r"op(1|3|4|5|9)_", n)):
        assert queries[name](spark, d).count() == docs_.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, d).cache()
        assert rows.columns == before.columns
        if name == "benchmark decontamination":
            assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in before.collect() if not brute_hits(r.text, items)[1])
        if name == "PII":
            assert rows.count() == before.count() and not any(base_spans(r.text) for r in rows.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, rows, d).count() == rows.count()
