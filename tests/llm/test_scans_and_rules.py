import base64
import json
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import odd_rows, prose, table
from vexil.llm import license_scan as ls, quality_rules as qr, secret_scan as ss


def test_templates_accept_what_their_markup_allows():
    a = ls.Automaton({"t": "alpha beta <<beginOptional>>gamma <<beginOptional>>delta<<endOptional>><<endOptional>> omega <<var;name=x;words=0-2>> end"})
    for text in ("alpha beta omega end", "Alpha, BETA: gamma omega x end", "alpha beta gamma delta omega x y end"):
        assert [m[0] for m in a.matches(ls.words_of(text))] == ["t"], text
    for text in ("alpha beta delta omega end", "alpha beta omega x y z end", "alpha omega end", "beta gamma omega end", "alpha beta omega"):
        assert not a.matches(ls.words_of(text)), text


def test_the_longest_match_stands_and_the_next_begins_behind_it():
    a = ls.Automaton({"t": "a b <<beginOptional>>c<<endOptional>>"})
    assert a.matches(ls.words_of("a b c a b a b c")) == [("t", 0, 3), ("t", 3, 5), ("t", 5, 8)]


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<var;name=x;words=1-2>> a"])
def test_bad_templates_fail(bad):
    with pytest.raises(ValueError):
        ls.Automaton({"t": bad})


def whole(name):
    """A text that the template accepts, with all optional parts."""
    text = ls.TEMPLATES[name].replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    return re.sub(r"<<var;[^>]*>>", "someone", text)


def test_every_template_accepts_its_own_text():
    a = ls.Automaton()
    for name in ls.TEMPLATES:
        n = len(ls.words_of(whole(name)))
        assert (name, 0, n) in a.matches(ls.words_of(whole(name))), name
        assert re.search(ls.prefilter(), whole(name).lower()), name


def test_license_scan(spark):
    mit, isc, bsd = (whole(n) for n in ("MIT", "ISC", "BSD-3-Clause"))
    rows = [
        (1, prose(5, 1) + "\n" + mit),
        (2, mit.replace("without restriction", "with restriction")),
        (3, "Licensed under the Apache License, Version 2.0"),
        (4, "x " * 300_000 + "All rights reserved"),
        (5, "all right reserved"),
        (6, mit[: mit.index("THE SOFTWARE IS PROVIDED")] + "The authors give full warranty."),
        (7, isc[: isc.index("THE SOFTWARE IS PROVIDED")]),
        (8, isc),
        (9, bsd),
        (10, bsd[: bsd.index("IN NO EVENT")] + " You may sue us."),
        (11, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ]
    found = sorted((r.doc_id, r.license_id) for r in ls.scan(table(spark, rows, clash=True)).collect() if r.license_id != "rights-reserved" or r.doc_id == 4)
    assert found == [(1, "MIT"), (3, "Apache-2.0-notice"), (4, "rights-reserved"), (8, "ISC"), (9, "BSD-3-Clause"), (11, "CC-BY-NC-4.0-spelled")]
    starts = {r.doc_id: r.start_word for r in ls.scan(table(spark, rows[3:4])).collect()}
    assert starts == {4: 300_000}
    assert ls.scan(table(spark, odd_rows(), clash=True)).count() == 0 and ls.scan(table(spark, [])).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body


def rsa():
    rng = np.random.default_rng(1)
    number = lambda n: der(2, b"\x01" + rng.bytes(n))
    return der(0x30, der(2, b"\0") + number(128) + der(2, b"\x01\0\x01") + b"".join(number(n) for n in (127, 64, 64, 64, 64, 64)))


def b64(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def test_only_secrets_of_right_structure_are_reported(spark):
    key = rsa()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
    broken = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key[:-9]).decode() + "-----END RSA PRIVATE KEY-----"
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, key))
    field = lambda x: struct.pack(">I", len(x)) + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"p" * 51) + field(b"q" * 136)
    head, claims = (b64(json.dumps(x).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"}))
    rng = np.random.default_rng(2)
    signed, short = (f"{head}.{claims}.{b64(rng.bytes(n))}" for n in (32, 31))
    body, value, check = "A" * 15 + "b" * 15, zlib.crc32(("A" * 15 + "b" * 15).encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = ss.BASE62[d] + check
    wrong = check[:-1] + ("0" if check[-1] != "0" else "1")
    random_hex = rng.bytes(32).hex()
    rows = [
        (1, f"{prose(4, 1)} {pem} {prose(4, 2)}"),
        (2, broken),
        (3, "k " + base64.b64encode(pkcs8).decode()),
        (4, "k " + base64.b64encode(ssh).decode()),
        (5, f"t={signed}"),
        (6, f"t={short}"),
        (7, f"ghp_{body}{check}"),
        (8, f"ghp_{body}{wrong}"),
        (9, f'api_key = "{random_hex}"'),
        (10, f'checksum "{random_hex}"'),
        (11, 'secret = "' + "ab" * 32 + '"'),
        (12, "y " * 200_000 + f"token: {random_hex}"),
    ]
    found = {(r.doc_id, r.kind) for r in ss.scan(table(spark, rows, clash=True)).collect()}
    assert found == {(1, "private_key_der"), (3, "private_key_der"), (4, "private_key_openssh"), (5, "signed_token"), (7, "checksum_token"), (9, "assigned_key"), (12, "assigned_key")}
    assert ss.scan(table(spark, odd_rows(), clash=True)).count() == 0 and ss.scan(table(spark, [])).count() == 0
    twice = ss.scan(table(spark, [rows[8], rows[8], (None, rows[8][1])])).collect()
    assert len(twice) == 3 and rows[8][1][twice[0].start : twice[0].end] == random_hex


def test_keys_in_hex_assigned_keys_dsa_and_cloud_secrets(spark):
    rng = np.random.default_rng(3)
    key, number = rsa(), lambda n: der(2, b"\x01" + rng.bytes(n - 1))
    p, q, g, y, x = (number(n) for n in (129, 21, 128, 128, 20))
    dsa = der(0x30, der(2, b"\0") + p + q + g + y + x)
    dsa8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\xce\x38\x04\x01") + der(0x30, p + q + g)) + der(4, x))
    ed = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, rng.bytes(32))))
    field = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"p" * 51) + field(b"q" * 136)
    armour = lambda body, name="": f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----"
    lines = lambda text: "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
    plain = lambda b: base64.b64encode(b).decode()
    cloud = plain(rng.bytes(30))
    small = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([i])) for i in range(5)))
    want = {
        f"k {key.hex()}": ("private_key_der", len(key)),
        f"k {key.hex().upper()} z": ("private_key_der", len(key)),
        f"k 0x{ssh.hex()}": ("private_key_openssh", len(ssh)),
        armour(lines(key.hex()), "RSA "): ("private_key_der", len(key)),
        f"signing_key={key.hex()}": ("private_key_der", len(key)),
        f"signing_key={plain(ssh)}": ("private_key_openssh", len(ssh)),
        f"key: {plain(ed)}": ("private_key_der", len(ed)),
        f"aws_secret_access_key = {cloud}": ("assigned_key", 30),
        armour(lines(plain(dsa)), "DSA "): ("private_key_der", len(dsa)),
        armour(lines(plain(dsa8))): ("private_key_der", len(dsa8)),
        f"k {key[:-9].hex()}": None,
        f"k {key.hex()}0": None,
        f"k {rng.bytes(64).hex()}": None,
        armour(plain(small + small)): None,
        armour(plain(small), "DSA "): None,
        f"checksum = {cloud}": None,
    }
    found = {r.doc_id: (r.kind, r.n_bytes) for r in ss.scan(table(spark, list(enumerate(want)))).collect()}
    assert found == {i: w for i, w in enumerate(want.values()) if w}


@pytest.mark.parametrize("run", ["-", "_", ".key", "-key", "key", "key ", "key=", "key: ", "a.", "=", "eyJ.", "AKIA", "ghp_", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "A", "0a", " ", "secret\t"])
def test_long_runs_take_time_in_proportion(run):
    began = time.perf_counter()
    ss.find_secrets(run * (1_000_000 // len(run)))
    assert time.perf_counter() - began < 20


def test_encrypted_and_nested_keys():
    parameters = der(0x30, der(4, b"s" * 16) + der(2, b"\x08\0"))
    sealed = lambda oid: der(0x30, der(0x30, der(6, bytes.fromhex(oid)) + parameters) + der(4, b"x" * 64))
    assert ss.key_kind(sealed("2a864886f70d01050d")) == "private_key_der"
    assert ss.key_kind(sealed("608648016503040201")) is None  # a digest has that form too
    key = rsa()
    for _ in range(2000):
        key = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, key)) if len(key) < 60_000 else key
    assert ss.key_kind(key) is None
    assert ss.find_secrets("x=api_key=" + b"0123456789abcdefghijklmnopqrstuv".hex())[0][2] == "assigned_key"


def brute_counts(text):
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x]
    solid = "".join(words)
    return len(words), len(solid), len(lines), sum(c in qr.MARKS for c in solid), sum("A" <= c <= "Z" for c in solid), sum("0" <= c <= "9" for c in solid), max(sum(len(x) < 20 for x in lines) - 1, 0), len(lines) - len(set(lines))


def test_rates_match_counting(spark):
    r = np.random.default_rng(5)
    rows = [(i, "".join(r.choice(list("abcXYZ019 .,#\n\n  é日😀"), r.integers(0, 120)))) for i in range(300)] + odd_rows()
    got = qr.measured(table(spark, rows)).collect()
    for x in got:
        n, solid, lines, marks, capitals, digits, short, repeats = brute_counts(x.text)
        if n == 0:
            assert x.n_words is None and x.word_length is None
            continue
        assert (x.n_words, x.n_solid, x.n_lines) == (n, solid, lines)
        assert [x.word_length, x.mark_rate, x.capital_rate, x.digit_rate, x.short_line_rate, x.repeat_line_rate] == [solid / n, marks / solid, capitals / solid, digits / solid, short / lines, repeats / lines]


def test_groups_beyond_k_stay_within_the_rank_error(spark):
    n = 20 * qr.K
    rows = spark.range(n).select(F.lit("en").alias("lang"), F.lit("web").alias("source"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 30)) / (1 << 30)).alias(rate) for i, rate in enumerate(qr.RULES)])
    limit, values = qr.fences(qr.sketches(rows), 0.0).first(), rows.toPandas()
    for rate, (_, _, _, low, _) in qr.RULES.items():
        assert abs((values[rate] < limit[f"{rate}_high"]).mean() - 0.75) < 0.02
        if low:
            assert abs((values[rate] < limit[f"{rate}_low"]).mean() - 0.25) < 0.02


def test_quartiles_decide_in_most_groups(spark, sf_dir):
    rows = qr.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)
    quartiles = [(F.percentile(r, 0.75) - F.percentile(r, 0.25) > floor).alias(r) for r, (floor, *_) in qr.RULES.items()]
    decided = rows.groupBy(*qr.GROUP).agg(F.count(F.lit(1)).alias("n"), *quartiles).where("n >= 8").toPandas()
    assert (decided[["word_length", "mark_rate", "capital_rate"]].mean() > 0.9).all()


def test_fences_follow_the_quartiles(spark):
    rows = [(i, prose(30, i), "en" if i % 2 else "de", "web") for i in range(200)] + [(1000, "### $$$ %%% &&& a " * 3, "en", "web"), (1001, "ABCDEF GHIJKL MNOPQR " * 5, "de", "web")]
    docs = table(spark, rows)
    kept = {r.doc_id for r in qr.kept_rates(docs).collect()}
    assert kept == set(range(200)) and {r.doc_id for r in qr.apply_rules(docs).collect()} == kept
    # brute force: exact quartiles of the measured rates
    pdf = qr.measured(docs).toPandas()
    for lang, part in pdf.groupby("lang"):
        limit = qr.fences(qr.sketches(qr.measured(docs))).where(F.col("lang") == lang).first()
        for rate, (floor, _, _, low, high) in qr.RULES.items():
            v = np.sort(part[rate].to_numpy())
            q1, q3 = v[max(0, int(np.ceil(0.25 * len(v))) - 1)], v[max(0, int(np.ceil(0.75 * len(v))) - 1)]
            if high:
                assert abs(limit[f"{rate}_high"] - (q3 + qr.REACH * max(q3 - q1, floor))) < 1e-9


def test_sketches_of_shards_merge(spark):
    docs = qr.measured(table(spark, [(i, prose(20 + i % 7, i)) for i in range(300)]))
    both = qr.sketches(docs.where("doc_id < 150")).unionByName(qr.sketches(docs.where("doc_id >= 150")))
    merged = both.groupBy(*qr.GROUP).agg(*[F.kll_merge_agg_double(r).alias(r) for r in qr.RULES])
    assert merged.select(F.kll_sketch_get_n_double("word_length")).first()[0] == 300
    a, b = qr.fences(merged).first(), qr.fences(qr.sketches(docs)).first()
    assert abs(a.word_length_low - b.word_length_low) < 0.3


def test_rules_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = qr.apply_rules(docs).collect()
    assert {"a"} == {r["__key"] for r in got} and all(r.text and r.text.strip() for r in got)
    assert len([r for r in got if r.doc_id == 1 and r.n_chars > 400]) == 2  # each of a repeated row's copies
    assert {(r.lang, r.source) for r in qr.sketches(qr.measured(docs)).collect()} >= {(None, None), (None, "web"), ("en", None)}
    assert qr.apply_rules(table(spark, [])).count() == 0 and qr.kept_rates(table(spark, [])).count() == 0
