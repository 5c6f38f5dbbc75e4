"""Secrets, licenses, toxicity and page text against brute force, parsing and labels."""

import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from barspark.llm import html_extract, license_scan, secret_scan, toxicity
from barspark.llm.queries import QUERIES, table, texts

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, b"\1" * n) for n in (128, 3, 128, 64, 64, 64, 64, 64)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1"), der(5)), der(4, RSA))
EC = der(0x30, der(2, b"\1"), der(4, b"\7" * 32))


def field(data):
    return len(data).to_bytes(4) + data


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(b"pub" * 9) + field(b"private" * 9)


def b64(data):
    return base64.b64encode(data).decode()


def token(header, payload):
    parts = [base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in (header, payload)]
    return ".".join([*parts, "c2ln"])


def brute_base(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.BASE.index(s[0])))


def test_base_spans_equal_brute_force():
    draw = random.Random(4)
    parts = ["password", "PassWD", "api_key", "apikey", "token", ":", "=", " ", '"', "'", "é", "secret", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeefdeadbeef", "/", ".", "\n", "ſecret"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        for runs in (True,):
            assert [s for s in secret_scan.scan(text, runs) if s[0] in secret_scan.BASE] == brute_base(text), text


@pytest.mark.parametrize("data", [RSA, PKCS8, EC, SSH])
def test_keys_are_confirmed_by_structure(data):
    body = b64(data)
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + "\n-----END PRIVATE KEY-----"
    assert ("key", 3, 3 + len(pem)) in secret_scan.scan("é: " + pem)
    assert ("key", 2, 2 + len(body)) in secret_scan.scan("x " + body + " y")
    if len(data) >= 40:
        assert ("key", 0, 2 * len(data)) in secret_scan.scan(data.hex())
    broken = data[:20] + b"\xff" + data[20:]
    assert not [s for s in secret_scan.scan(b64(broken)) if s[0] == "key"]


def lines_of(data, width=64):
    return [b64(data)[i : i + width] for i in range(0, len(b64(data)), width)]


def keys_in(text):
    return [text[a:b] for kind, a, b in secret_scan.scan(text) if kind == "key"]


@pytest.mark.parametrize("data", [RSA, PKCS8, EC, SSH])
def test_keys_in_code_and_json(data):
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    pem = "\n".join([begin, *lines_of(data), end, ""])
    for text in (
        json.dumps({"type": "service_account", "private_key": pem}),
        json.dumps(json.dumps({"private_key": pem.replace("\n", "\r\n")})),
        "key = " + " +\n    ".join(json.dumps(line + "\n") for line in pem.splitlines()) + ";",
        "key = [" + ",\n".join(f"'{line}'" for line in pem.splitlines()) + "].join('')",
        "# " + pem.replace("\n", "\n# "),
    ):
        (found,) = [k for k in keys_in(text) if begin in k]
        assert found.startswith(begin) and found.endswith(end)
        assert not any(line in secret_scan.mask(text, secret_scan.scan(text)) for line in lines_of(data))
        wrong = text.replace(lines_of(data)[0], lines_of(data)[0][4:])
        assert not [k for k in keys_in(wrong) if begin in k]


@pytest.mark.parametrize("data", [RSA, PKCS8, SSH])
def test_wrapped_keys_without_marks(data):
    for join in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n", '" +\n  "', "',\n'", '\\n" +\n  "'):
        for width in (64, 76, 25):
            body = join.join(lines_of(data, width))
            for text in (f"Key:\n{body}\nThe end", f'x = "{body}"', f"Aword{'x' * 30}\n{body}\nword", f'"k": "\\n{body}\\n"'):
                assert keys_in(text) == [body], text
            assert not keys_in(f"Key:\n{body}AAAA\n") and not keys_in(body[:-8])
    assert keys_in('{"k": "\\n' + b64(data) + '\\n"}') == [b64(data)]


def test_legacy_encrypted_keys():
    for cipher, vector, size in (("AES-128-CBC", "0F" * 16, 16), ("DES-EDE3-CBC", "0F" * 8, 8)):
        for n, good in ((608, True), (size, True), (607, False)):
            pem = "\n".join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", f"DEK-Info: {cipher},{vector}", "", *lines_of(random.Random(n).randbytes(n)), "-----END RSA PRIVATE KEY-----"])
            for text in (pem, json.dumps(pem)[1:-1]):
                assert keys_in(f"a {text} b") == ([text] if good else []), (cipher, n)
        assert not keys_in(pem.replace(vector, "0F"))
        assert not keys_in(pem.replace("Proc-Type: 4,ENCRYPTED\n", ""))


def test_pgp_private_keys():
    body = b"\4" + random.Random(3).randbytes(400)
    packet, other = b"\x95" + len(body).to_bytes(2) + body, b"\x99" + len(body).to_bytes(2) + body
    new = b"\xc5\xff" + len(body).to_bytes(4) + body + b"\xcd\4name"
    begin, end = "-----BEGIN PGP PRIVATE KEY BLOCK-----", "-----END PGP PRIVATE KEY BLOCK-----"
    for data, good in ((packet, True), (new, True), (packet[:-3], False), (other, False)):
        pem = "\n".join([begin, "Version: GnuPG v2.0.22 (GNU/Linux)", "Comment: https://example.org", "", *lines_of(data), "=AAAA", end])
        for text in (pem, json.dumps(pem)[1:-1]):
            assert keys_in(f"a {text} b") == ([text] if good else [])


def test_signed_tokens_need_json_headers():
    good = token({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})
    assert [s for s in secret_scan.scan(f"a {good} b") if s[0] == "jwt"] == [("jwt", 2, 2 + len(good))]
    assert not [s for s in secret_scan.scan(token({"typ": "JWT"}, {"sub": 1})) if s[0] == "jwt"]
    assert not [s for s in secret_scan.scan("eyAAAAAAAAAAAA.BBBBBBBBBBBBBB.CC") if s[0] == "jwt"]


def test_secret_columns(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "é token=abcdef1", "k"), (3, "é token=abcdef1", "k"), (4, "x" * 3_000_000 + " AKIA" + "Z" * 16, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = secret_scan.secret_spans(df).select("doc_id", secret_scan.joined(F.col("secrets")).alias("s"), "kind").collect()
    assert [(r.doc_id, r.s) for r in got] == [(1, ""), (2, ""), (3, "assign:2:15"), (3, "assign:2:15"), (4, "access:3000001:3000021")]
    masked = [r.text for r in secret_scan.redact(df).collect()]
    assert masked[:3] == [None, "", "é [SECRET]"] and masked[4].endswith(" [SECRET]")
    assert secret_scan.secret_spans(df.limit(0)).count() == 0


def test_op2_over_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op2_secret_scan"](spark, SF).collect()}
    for r in texts(spark, SF).collect():
        base = brute_base(r.text or "")
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (own.n_assign, own.n_access, own.n_hex) == tuple(sum(s[0] == k for s in base) for k in secret_scan.BASE)
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(own.spans.split(",")) | {""}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_licenses(text):
    """Places of phrases, and labels by trying every template at every place with a few words of slack."""
    words = words_of(text)
    places = [(i, label) for i in range(len(words)) for p, label in license_scan.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    k, share, labels = license_scan.K, 0.0, set()
    for label, template in license_scan.TEMPLATES:
        own = words_of(template)
        votes = {}
        for p in range(len(words) - k + 1):
            for q in range(len(own) - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    votes.setdefault(p - q, set()).add(q)
        group, last = set(), None
        for diagonal in sorted(votes):
            if last is not None and diagonal - last > license_scan.SLACK:
                group = set()
            group = group | votes[diagonal]
            last = diagonal
            coverage = len(group) / (len(own) - k + 1)
            if coverage >= license_scan.COVERAGE:
                labels.add(label)
                share = max(share, coverage)
    return len(words), places, sorted(labels), 1.0 if places else share


def test_licenses_equal_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{draw.randrange(50)}" for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            own = draw.choice(license_scan.TEMPLATES)[1].split()
            if draw.random() < 0.5:
                own.insert(draw.randrange(len(own)), "really")
            if draw.random() < 0.5:
                own = own[: draw.randrange(2, len(own) + 1)]
            at = draw.randrange(len(words) + 1)
            words[at:at] = own
        rows.append((i, ", ".join(words)))
    rows += [(70, None), (71, ""), (72, "MIT License MIT\tlicense"), (None, "the MIT License"), (73, "Released under the MİT License"), (74, "mit"), (74, "mit")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, words int")
    got = sorted(((r.doc_id, r.n_words, [tuple(p) for p in r.places], r.found, r.score) for r in license_scan.scan_licenses(df).collect()), key=str)
    expected = []
    for i, t in rows:
        n, places, labels, score = brute_licenses(t)
        expected.append((i, n, places, labels, score))
    assert got == sorted(expected, key=str)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
CC = "This work is licensed under a Creative Commons {} License."
NOTICES = [
    (CC.format("Attribution 4.0 International"), "cc-by"),
    (CC.format("Attribution-ShareAlike 4.0 International"), "cc-by-sa"),
    (CC.format("Attribution-NonCommercial 4.0 International"), "cc-by-nc"),
    (CC.format("Attribution-NonCommercial-ShareAlike 4.0 International"), "cc-by-nc-sa"),
    (CC.format("Attribution-NoDerivatives 4.0 International"), "cc-by-nd"),
    (CC.format("Attribution-ShareAlike 3.0 Unported"), "cc-by-sa"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    (GNU.format("library", ";", "Lesser "), "lgpl"),
    (GNU.format("program", ":", "Lesser "), "lgpl"),
    (GNU.format("program", ":", "Affero "), "agpl"),
    (GNU.format("program", ":", ""), "gpl"),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "lgpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
]


def test_notices_that_share_their_words_get_their_own_label(spark):
    rows = [(i, f"Some words before. {text} Some words after.") for i, (text, _) in enumerate(NOTICES)]
    rows.append((len(rows), " and then ".join(text for text, _ in NOTICES)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = license_scan.scan_licenses(df).withColumn("labels", license_scan.labels())
    got = {r.doc_id: (r.found, r.labels) for r in scanned.collect()}
    for i, (text, label) in enumerate(NOTICES):
        base = {name for phrase, name in license_scan.PHRASES.items() if phrase in " ".join(re.findall(r"[a-z0-9]+", text.lower()))}
        assert got[i] == ([label], sorted({label, *base})), text
    every = sorted({label for _, label in NOTICES})
    assert got[len(NOTICES)] == (every, every)


WORDS = "One sentence here, with words and marks. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article>One</article><article>Two</article></body>", "One\n\nTwo"),
        ("<body><div><article>One</article></div><div><article>Two</article></div></body>", "One\n\nTwo"),
        ('<body><div class="site has-sidebar"><article><p>One.</p></article><div class="sidebar">S</div></div></body>', "One."),
        ('<body><article class="post comment-open"><p>One.</p></article></body>', "One."),
        ('<body><article class="post comment-open"><p>One.</p></article><div id="comments">' + f"<p>{WORDS}</p>" * 9 + "</div></body>", None),
        (f'<div class="post-share-enabled"><p>{WORDS}</p></div>', WORDS.strip()),
        (f'<div class="social page"><div class="share">tell</div><p>{WORDS}</p></div>', WORDS.strip()),
        ('<article><p class="a" ">First para.</p><p>It\'s "second".</p></article>', 'First para.\n\nIt\'s "second".'),
        ("<article><p title='a>b' id=\"x>\">First.</p><p a = 'q>'>Second.</p></article>", "First.\n\nSecond."),
        ("<main><ul>" + "<li><a href=/>Item here</a></li>" * 5 + f"</ul><p>{WORDS}</p><p>Short.</p></main>", f"{WORDS.strip()}\n\nShort."),
        ("<main><p>Read <a href=/>this</a>.</p><ul><li>See <a href=/>that</a> too<li>plain<li>end</ul></main>", "Read this.\n\nSee that too\n\nplain\n\nend"),
    ],
)
def test_marked_wrappers_several_articles_and_stray_quotes(page, text):
    got = html_extract.main_text(page)
    assert got == text if text is not None else got.startswith("One.")
    assert all(html_extract.main_text(page) == got for _ in range(5))


def test_hostile_lines_are_read_once():
    import base64
    import time

    huge = base64.b64encode(b"\x30\x84\x7f\xff\xff\xff\x02\x01\x00" + bytes(39)).decode()
    begin = time.perf_counter()
    assert list(secret_scan.wrapped_keys("\n".join([huge] * 40_000))) == []
    assert time.perf_counter() - begin < 20


def test_dsa_keys_and_encoded_pem_files_are_confirmed():
    import base64

    def der(tag, body):
        size = len(body)
        return bytes([tag, size] if size < 128 else [tag, 0x81, size] if size < 256 else [tag, 0x82, *size.to_bytes(2)]) + body

    numbers = [b"\x00", b"\x7f" * 128, b"\x7f" * 20, b"\x7f" * 128, b"\x7f" * 128, b"\x7f" * 20]
    key = der(0x30, b"".join(der(2, n) for n in numbers))
    assert secret_scan.is_der_key(key) and not secret_scan.is_der_key(key[:-1] + b"\x30\x00")
    lines = base64.encodebytes(key).decode()
    pem = f"-----BEGIN DSA PRIVATE KEY-----\n{lines}-----END DSA PRIVATE KEY-----\n"
    assert [k for k, *_ in secret_scan.scan(f"x {pem} y")][0] == "key"
    encoded = base64.b64encode(pem.encode()).decode()
    assert secret_scan.scan(f"tls.key: {encoded}") == [("key", 9, 9 + len(encoded))]
    wrapped = base64.encodebytes(key).decode()
    assert list(secret_scan.wrapped_keys(f"a:\n{wrapped}\nend")) == [(3, 3 + len(wrapped.rstrip()))]


def test_license_scan_has_no_python(spark):
    plan = QUERIES["op10_license_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_op10_over_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    for r in texts(spark, SF).collect():
        n, places, labels, score = brute_licenses(r.text)
        own, base = got[r.doc_id], sorted({x for _, x in places})
        at = [i for i, _ in places]
        assert (own.n_words, own.n_base, own.first_word, own.last_word) == (n, len(places), min(at, default=None), max(at, default=None))
        assert (own.base_labels, own.labels, own.score) == (",".join(base), ",".join(sorted({*base, *labels})), score)


@pytest.mark.parametrize("name, own", [("Lesser", "lgpl"), ("Affero", "agpl")])
def test_phrases_in_other_names_keep_their_label(spark, name, own):
    df = spark.createDataFrame([(1, f"Licensed under the GNU {name} General Public License")], "doc_id long, text string")
    row = license_scan.scan_licenses(df).withColumn("labels", license_scan.labels()).first()
    assert [p.label for p in row.places] == ["gpl"] and row.labels == sorted({"gpl", own})


def distance_one(a, b):
    """One edit or one swap of neighbours, by definition."""
    if a == b:
        return True
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or (len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]])
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_equals_edit_distance():
    draw = random.Random(6)
    terms = {"idiot": 1.0, "trash": 1.0, "abcabc": 1.0, "aaaaa": 1.0, "stupid": 1.0}
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        word = list(draw.choice(list(terms)))
        for _ in range(draw.choice([0, 1, 1, 2])):
            k = draw.randrange(len(word))
            edit = draw.randrange(4)
            if edit == 0:
                word[k] = draw.choice("abcdit")
            elif edit == 1:
                word.insert(k, draw.choice("abcdit"))
            elif edit == 2 and len(word) > 1:
                del word[k]
            elif k + 1 < len(word):
                word[k], word[k + 1] = word[k + 1], word[k]
        word = "".join(word)
        assert bool(trie.near(word)) == any(distance_one(word, t) for t in terms), word


def toy(spark):
    draw = random.Random(9)
    plain = ["river", "stone", "window", "paper", "garden", "winter"]
    rows, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) + str(draw.randrange(30)).replace("1", "") for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[draw.randrange(40)] = draw.choice(["idiot", "stupid", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_misspelled_and_quoted_terms(spark):
    docs, labels = toy(spark)
    model = toxicity.learn(docs, labels)
    assert set(model.terms) == {"idiot", "stupid", "worthless"}
    rows = [
        (1, "you are an idiot and a stupid one"), (2, "quite an idoit, a stupd and wortless fellow"), (3, 'he wrote "idiot" on the stone'),
        (4, "a calm river"), (5, None), (6, ""), (6, ""),
    ]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, weight double")
    got = [(r.doc_id, r.score) for r in toxicity.score(df, model).collect()]
    score = dict(got)
    assert score[1] >= 0.7 and score[2] >= 0.7 and score[3] < 0.7 and score[4] < 0.3 and score[3] < score[1]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got) and score[5] == score[6]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_misspellings_where_the_labels_hold_some(spark):
    docs, labels = toy(spark)
    text = F.col("text")
    for i, (word, other) in enumerate([("idiot", "idioht"), ("idiot", "idiocy"), ("worthless", "worthliss"), ("worthless", "worthlss"), ("stupid", "stupiid")]):
        text = F.when(F.col("doc_id").isin(8 + 40 * i, 20 + 40 * i, 32 + 40 * i), F.regexp_replace(text, word, other)).otherwise(text)
    model = toxicity.learn(docs.withColumn("text", text), labels)
    assert any("idiot".startswith(t) for t in model.terms) and not {"idiot", "worthless"} <= model.terms.keys()
    words = ["idoit", "wrothless", "stpuid", "idiot", "worthless", "stupid"]
    rows = [(i, f"river stone {w} window {w} paper") for i, w in enumerate(words)] + [(9, "river stone window paper")]
    score = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(score[i] >= 0.7 for i in range(len(words))), score
    assert score[9] < 0.3
    matcher = toxicity.Matcher(model)
    assert all(any(matcher.kind(w)) for w in words)


def test_rare_terms_count_by_evidence_alone(spark):
    rows = [(i, f"river {i} stone {7 * i} window {3 * i} {'zumpel' if i % 9 == 0 and i < 63 else 'idiot' if i % 9 == 0 else 'paper'}") for i in range(18_000)]
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert toxicity._least_hits(2_000, 16_000) == 6 and toxicity._least_hits(50, 50) == 18
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert set(model.terms) == {"zumpel", "idiot"}


def test_frequent_clean_beginnings_do_not_crowd_out_terms(spark):
    docs, labels = toy(spark)
    assert set(toxicity.learn(docs, labels).terms) == {"idiot", "stupid", "worthless"}


def test_only_near_copies_are_left_out(spark):
    import numpy as np

    draw = random.Random(2)
    words = [f"w{draw.randrange(10_000)}" for _ in range(400)]
    near = [*words[:200], "other", *words[200:]]
    half = [*words[:230], *[f"v{draw.randrange(10_000)}" for _ in range(170)]]  # a Jaccard of 0.4
    texts_ = [" ".join(words), " ".join(words), " ".join(near), " ".join(half), "", "one", "two", "one"]
    import pyarrow as pa

    sketches = np.array(next(toxicity._sketch(iter([pa.array(texts_)]))).to_pylist())
    assert toxicity.far_apart(sketches).tolist() == [0, 3, 4, 5, 6]


def test_model_without_labels_finds_nothing(spark):
    docs, labels = toy(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.learn(docs, some)
        assert not model.terms
    assert toxicity.score(docs, model).filter("score >= 0.7").count() == 0


def test_op3_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, sf)
    assert got.count() == texts(spark, sf).count()
    judged = got.filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    toxic, clean = [r for r in judged if r.toxic], [r for r in judged if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    better = sum(a.score > b.score for a in toxic for b in clean) + 0.5 * sum(a.score == b.score for a in toxic for b in clean)
    assert better / (len(toxic) * len(clean)) >= 0.75


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>
<div class="cookie-notice">Cookies, please.</div><article><h1>Head &amp; line</h1><p><b>First  one,
really.<br><p>Second &lt;one&gt;. <script>no("</p>")</script>More.</p><aside>side</aside><form><input>f</form>
<ul><li>x<li>y</ul></article><div id="comments"><p>A long comment, by a reader.</p></div><footer>foot</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst one, really.\n\nSecond <one>. More.\n\nx\n\ny"
    soup = "<body><div class=menu><a href=a>A link</a></div><div><div><p>A long one, with marks. Yes.</p><p>Another one, also long.</p><p>Be.</p></div></div></body>"
    assert html_extract.main_text(soup) == "A long one, with marks. Yes.\n\nAnother one, also long.\n\nBe."
    for page, text in [("", ""), ("<p>", ""), ("just text", "just text"), ("<p>cut<p", "cut"), ("<article><p>a &am", "a &am"), ("<!-- x", ""), ("a < b", "a < b")]:
        assert html_extract.main_text(page) == text


@pytest.mark.parametrize("count", [2, 5, 20, 200])
def test_page_text_is_whole_at_any_length(count):
    body = [f"Paragraph {i} tells a part of the story, with marks, and goes on for a while." for i in range(count)]
    inner = "<h1>Title</h1><p class=lead>What it is about, in one line of text.</p><div class=body>" + "".join(f"<p>{x}</p>" for x in body)
    inner += "<ul><li>x<li>y</ul></div><p>A closing paragraph, after the body of it.</p>"
    expected = "\n\n".join(["Title", "What it is about, in one line of text.", *body, "x", "y", "A closing paragraph, after the body of it."])
    menu = "<div class=menu><a href=a>A link</a></div>"
    for page in (f"<html><body>{menu}<div id=post>{inner}</div></body></html>", f"<body>{menu}{inner}</body>", inner):
        assert html_extract.main_text(page) == expected
    alone = "<div id=post><h1>Title</h1><div class=body>" + "".join(f"<p>{x}</p>" for x in body) + "</div></div>"
    assert html_extract.main_text(alone) == "\n\n".join(["Title", *body])


def test_content_paths_prefer_text_over_links():
    soup = "<div><table><tr><td>" + "".join(f"<a href={i}>link {i}</a> " for i in range(30)) + "</td></tr></table><section><p>" + "Words, and more. " * 9 + "</p></section></div>"
    paths = html_extract.content_paths(html_extract.blocks_of(soup))
    assert paths == {("div", "section", "p")}


def test_pages_query(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (2, "u", None, "x"), (3, None, "<p>" + "long text. " * 200_000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text_ string")
    got = html_extract.extract(df).collect()
    assert [len(r.text) for r in got] == [len(html_extract.main_text(PAGE)), 0, 0, 11 * 200_000 - 1] and got[0].text_ == "x"
    assert html_extract.extract(df.limit(0)).count() == 0
    for r in QUERIES["op4_html_extract"](spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*(>|$)", " ", b) for b in re.split(r"</?p>|</?h1>", body)]
        import html

        expected = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in expected if b) and r.n_chars == len(r.text)
