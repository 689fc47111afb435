"""Secret scans, token alignment and importance resampling against brute force, and on awkward rows."""

import base64
import bz2
import collections
import gzip
import hashlib
import json
import lzma
import math
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mediacat.llm import importance_resampling, queries, secret_scan, token_alignment
from oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(11)
    alphabet = "abTI é́ 日\n\r\t  .,;'<|>()x'　\xa0\x85\x1c▁ﬁ\x00😀"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 40, 200]))) for _ in range(400)]
    out += ["a<|endoftext|> <s>b</s> <0x0A>", " lead", "trail ", "a  b   c", "x;\r\ny", None, "", " ", "\n\n", "word " * 3000, "a" * 500, "one two one two"]
    return out + [d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def aligned(rows):
    """Everything by the libraries, whole text by whole text, and all pairs of tokens compared by their bytes."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    held, docs = [], collections.Counter()
    for text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(byte[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in x]
        yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        data = (" " + (text or "")).encode()
        if not text or b"".join(xb) != data or b"".join(yb) != data:
            held.append(None)
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        links, groups, j0 = [], [[[], []]], 0
        for i, (s, e) in enumerate(zip([0, *xe], xe)):
            while ye[j0] <= s:
                j0 += 1
            j = j0
            while j < len(ye) and (ye[j - 1] if j else 0) < e:
                links.append((x[i], y[j]))
                j += 1
        at = sorted([(e, 0, i) for e, i in zip(xe, x)] + [(e, 1, i) for e, i in zip(ye, y)])
        both = set(xe) & set(ye)
        for k, (e, side, i) in enumerate(at):
            groups[-1][side].append(i)
            if e in both and (k + 1 == len(at) or at[k + 1][0] != e):
                groups.append([[], []])
        held.append((len(x), len(y), groups[:-1], links))
        docs.update(set(links))
    best = collections.Counter()
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = h
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_alignment_equals_the_libraries(spark, partitions, monkeypatch):
    monkeypatch.setattr(token_alignment, "HELD_SUMS", 5000)
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 5000)
    rows = texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(partitions)
    got = {r[0]: tuple(r[1:]) for r in token_alignment.token_alignment(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    want = aligned(rows)
    assert len(got) == len(rows) and [k for k in got if got[k] != want[k]] == []
    assert sum(w[0] == 0 for w in want) > 5 and sum(w[0] > 0 for w in want) > 300


def test_packed_numbers():
    x, y = np.array([1, 255, 70000]), np.array([0, 1, 2])
    assert [v.tolist() for v in token_alignment.unpacked(token_alignment.packed(x, y))] == [x.tolist(), y.tolist()]
    assert [v.tolist() for v in token_alignment.unpacked(token_alignment.packed(x[:0]))] == [[]]


def base_findings(text):
    text = text or ""
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = [("assign", m.start(), m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))


def spelled(found):
    return ",".join(":".join(map(str, f)) for f in found)


def test_base_secrets_equal_the_plain_patterns(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    out = queries.op11_secret_scan(spark, sf).collect()
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    assert len(out) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in out) > 10
    for r in out:
        want = base_findings(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[0] == k for f in want) for k in ("assign", "access", "hex")]
        assert set(spelled(want).split(",")) <= set(r["spans"].split(",")) and r["unopened"] == 0


@pytest.mark.parametrize("text", ["secret=token:abcdef", "token=a:secret=abcdefg", "ſecret=abcdefgh", "TOKEN ' = x", "api_key=\"abcdef\" apikey: abc", "AKIA" + "A" * 15, "AKIAAKIA" + "9" * 12, "a" * 23, "a" * 24 + "g", "é" * 5 + "Token = 'a.b-c_d'"])
def test_edges_of_the_patterns(text):
    got = sorted((secret_scan.KINDS[k], a, b) for k, a, b in secret_scan.findings(text))
    assert got == sorted(base_findings(text))


SECRET = "password = 'hunter2hunter2'"
LAYERS = {
    "url": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04X}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "urlsafe": lambda t: base64.urlsafe_b64encode(b"\xfb\xff " + t.encode()).decode().rstrip("="),
    "wrapped": lambda t: base64.encodebytes((t + "\n" + "filler " * 20).encode()).decode(),
    "shifted": lambda t: "ab" + base64.b64encode(t.encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "bz2": lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
    "xz": lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
    "zstd": lambda t: base64.b64encode(__import__("zstandard").compress(t.encode())).decode(),
    "binary_url": lambda t: urllib.parse.quote_from_bytes(zlib.compress(t.encode())),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers_are_unwrapped(inner, outer):
    hidden = LAYERS[outer](LAYERS[inner](SECRET))
    text = f"some prose, é before\n{hidden}\nand after it."
    start, end = text.index(hidden), text.index(hidden) + len(hidden)
    found, unopened = secret_scan.scan(text)
    inside = [(a, b) for k, a, b, path in found if k == 0 and path]
    assert inside and unopened == 0
    assert all(start <= a < b <= end for a, b in inside)


def test_spans_are_those_of_the_characters():
    text = "x pass%77ord%3Dabc%2541def y"
    assert ("assign", 2, 26) in {(secret_scan.KINDS[k], a, b) for k, a, b, _ in secret_scan.scan(text)[0]}
    coded = base64.b64encode(b"0123456789 token=abcdefgh and more").decode()
    (kind, a, b, path), = secret_scan.scan(f"- {coded} -")[0]
    assert path == "base64" and base64.b64decode(coded[(a - 2) // 4 * 4 : -(-(b - 2) // 4) * 4]).strip(b"0123456789 ").startswith(b"token=abcdefgh")
    assert (a - 2, b - 2) == (11 * 4 // 3, -(-25 * 4 // 3))


def test_any_number_of_levels_of_escapes():
    for levels in (3, secret_scan.LEVELS - 1, secret_scan.LEVELS, secret_scan.LEVELS + 1, 40):
        hidden = LAYERS["url"](SECRET)
        for _ in range(levels):
            hidden = hidden.replace("%", "%25") if _ % 3 else hidden.replace("%", "\\x25")
        assert any(k == 0 and a == 2 for k, a, *_ in secret_scan.scan(f"x {hidden} y")[0])
    assert secret_scan.fully_unescaped("%2541%%34%32")[0] == "AB" and secret_scan.unescaped("%2541%%34%32")[0] == "%41%42"


def test_cycles_end_and_bombs_are_told(monkeypatch):
    bomb = base64.b64encode(zlib.compress(bytes(3 << 20) + b" token=abcdefgh")).decode()
    assert [f[0] for f in secret_scan.scan(bomb)[0]] == [0] and secret_scan.scan(bomb, most=1 << 20) == ([], 1)
    itself = base64.b64encode(b"\x1f\x8b\x08 this unpacks to itself: token=abcdefgh").decode()
    monkeypatch.setattr(secret_scan, "unpacked", lambda data, most: (data, len(data)))
    found, _ = secret_scan.scan(itself)
    assert any(path == "base64>compressed" or path == "base64" for *_, path in found)


def test_deep_and_long_texts_take_time_in_proportion():
    import time

    began = time.time()
    assert secret_scan.scan("%" + "25" * 150_000 + "41 token%3Dabcdefgh")[0]
    for text in ("%4%3" * 100_000, "ab" * 300_000, "\\u005cu005c" * 50_000, "word " * 100_000):
        secret_scan.scan(text)
    assert time.time() - began < 30


def plain_draw(docs, target, percent=25, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: w + [f"{x} {y}" for x, y in zip(w, w[1:])]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for x in part for f in runs(words(x))) for part in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        f = runs(words(text))
        g = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + 10000) / (float(s[b] + 1) * float(all_t + 10000)))) for b in map(bucket, f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in out)


def test_resampling_equals_brute_force_and_sql(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    target = [d["text"] for d in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = queries.op13_importance_resampling(spark, SF)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_draw(docs, target)
    assert spark_rows(got) == sql_rows(queries.oracle_sql()["op13_importance_resampling"], "sf0.001")


def test_combined_crcs_are_those_of_the_runs():
    rnd = random.Random(9)
    rows = ["", None, "One", "é" * 3000 + " b"] + [" ".join("".join(rnd.choice("aB9éß-ſ日") for _ in range(rnd.choice([1, 3, 9, 70]))) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    crc, owner, n = importance_resampling.features(pa.array(rows), 4)
    want = []
    for k, t in enumerate(rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert n[k] == len(w)
        want += [(k, zlib.crc32(" ".join(w[i : i + j]).encode())) for j in range(1, 5) for i in range(len(w) - j + 1)]
    assert sorted(zip(owner.tolist(), crc.tolist())) == sorted(want)


def test_ranks_of_ties_and_hot_ids(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(None, text)] * 40 + [(5, text)] * 40 + [(k, text) for k in range(100, 160)] + [(7, "short"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    out = importance_resampling.importance_resampling(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in out) == plain_draw(rows, ["w1 w2", None])
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 36))


def test_new_operators_on_awkward_rows(spark):
    prose = " ".join(f"the of word{k} und" for k in range(60))
    rows = [(1, None), (2, ""), (2, ""), (None, prose), (3, prose), (3, prose), (5, "word " * 40_000), (6, " \n\t "), (7, "é" * 5000), (None, None), (8, "token=abcdefgh")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain.selectExpr("*", *[f"'odd' AS {x}" for x in "kind a slice n data ids digests part parts found spans start end at task rank score weight n_words before spread bucket".split()])
    for apply in (lambda d: secret_scan.secret_scan(d), lambda d: token_alignment.token_alignment(d, A, B), lambda d: importance_resampling.importance_resampling(d, d.where("doc_id = 3"))):
        want = sorted(str(tuple(r)) for r in apply(plain).collect())
        assert len(want) == len(rows) and sorted(str(tuple(r)) for r in apply(clash).collect()) == want
        assert apply(clash.limit(0)).count() == 0
