"""Globs by index and provider sets as classes, against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from keyscape.functions import ports, text
from keyscape.operators import authority, evidence


def glob(pattern, name):
    """Path-style matching: ``*`` and ``?`` stop at a slash, a malformed pattern matches
    nothing."""
    if not re.fullmatch(r"([^\[\\]|\\.|\[\^?([^\]\\]|\\.)+\])*", pattern):
        return False
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[":
            end = pattern.index("]", k + 2 if pattern[k + 1] == "^" else k + 1)
            out, k = out + pattern[k : end + 1], end + 1
            continue
        if c == "\\":
            out, k = out + re.escape(pattern[k + 1]), k + 2
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return re.fullmatch(out, name) is not None


PATTERNS = [
    "*", "?*", "*.com", "*.corp.example", "www.*", "*mail*", "a*b.com", "*x", "x*", "[ab]*.net", "*[0-9]", "[x", "*\\",
    "web-?.corp.example*", "*.*", "*é*", "host.corp.example", "**", "*.example", "*-*", "*/b", "[^w]*.com", "*.corp.exampl?",
    "[*]x*", "w\\*w*"]


def test_globs_meet_their_names_through_keys(spark):
    r = random.Random(4)
    parts = ["www", "mail", "web-1", "host", "a1b", "x", "corp.example", "com", "net", "é", "ab", "b.com", "a/b"]
    names = {".".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(150)} | {"", "host.corp.example"}
    got = evidence.matched_patterns(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))
    want = {(n, p) for n in names for p in PATTERNS if n == p or ("*" in p and glob(p, n))}
    rows = [tuple(x) for x in got.select("name", "pattern").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300


def test_no_glob_is_looked_up_by_nothing(spark):
    rows = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").filter(text.glob_is_valid("pattern"))
    keys = {r.pattern: r.k for r in rows.select("pattern", text.glob_key("pattern").alias("k")).collect()}
    assert "[x" not in keys and "*\\" not in keys
    assert {p for p, k in keys.items() if k is None} == {"*", "?*", "**", "*[0-9]"}
    assert keys["*.corp.example"] == "E.corp.example" and keys["*.com"] == "E.com" and keys["*mail*"] == "Gmai"
    assert keys["a*b.com"] == "Gb.c" and all(k is None or len(k) > 1 for k in keys.values())


def test_certificates_of_a_responder(spark):
    names = spark.createDataFrame([
        ("10.0.0.1", " WWW.Corp.Example "), ("10.0.0.1", "db.corp.example"), ("10.0.0.2", "mail.other"), ("10.0.0.3", "none")],
        "dst string, server_name string")
    certs = spark.createDataFrame([
        ("f1", ["*.corp.example"]), ("f2", ["www.corp.example", "db.corp.example"]), ("f3", ["mail*", "[bad"]),
        ("f4", ["*.corp.example", "mail.other"])], "fingerprint string, names array<string>")
    got = {r.ip: r.tls_fingerprints for r in evidence.tls_fingerprints(names, certs).collect()}
    assert got == {"10.0.0.1": ["f1", "f2", "f4"], "10.0.0.2": ["f3", "f4"]}


def _edges(spark, pairs):
    rows = [(src, dst, port, "protocol-confirmed") for src, dst, port in pairs]
    return spark.createDataFrame(rows, "src string, dst string, port int, evidence string")


def _service_pairs(count=40):
    r = random.Random(7)
    sets = [[("10.0.0.1", 53), ("10.0.0.2", 53)], [("10.0.0.1", 53), ("10.0.0.3", 53), ("10.0.0.2", 53)], [("10.0.0.4", 53)],
            [("10.0.0.1", 445), ("10.0.0.2", 445)]]
    return [(f"10.1.0.{k}", *p) for k in range(count) for s in r.sample(sets, 2) for p in s]


def test_classes_are_the_exact_provider_sets(spark):
    pairs = set(_service_pairs())
    members, providers = authority.provider_classes(_edges(spark, pairs))
    names = {r.port: r.s for r in spark.createDataFrame([(53,), (445,)], "port int").select(
        "port", ports.service_name("port").alias("s")).collect()}
    sets = defaultdict(set)
    for src, dst, port in pairs:
        sets[names[port], src].add((dst, port))
    classes = defaultdict(list)
    for (service, src), p in sets.items():
        if len(p) > 1:
            classes[service, frozenset(p)].append(src)
    want = {(service, src, min(c)) for (service, _), c in classes.items() for src in c}
    assert {tuple(r) for r in members.select("service", "src", "cls").collect()} == want
    assert {(r.service, r.cls, r.ip, r.port, r.clients) for r in providers.collect()} == {
        (service, min(c), *x, len(c)) for (service, p), c in classes.items() for x in p}


def test_equal_digests_of_different_sets_are_told_apart(spark):
    """Digests that say nothing: the counts still find what is one set and what isn't."""
    rows = [("dns", "c1", "10.0.0.1", 53), ("dns", "c1", "10.0.0.2", 53), ("dns", "c2", "10.0.0.1", 53), ("dns", "c2", "10.0.0.3", 53),
            ("smb", "c1", "10.0.0.1", 445), ("smb", "c1", "10.0.0.2", 445), ("smb", "c2", "10.0.0.1", 445), ("smb", "c2", "10.0.0.2", 445)]
    pairs = spark.createDataFrame(rows, "service string, src string, ip string, port int")
    signed = pairs.groupBy("service", "src").agg(F.count("*").alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    members, providers = authority._verified(pairs, signed)
    assert {tuple(r) for r in members.collect()} == {
        ("dns", "c1", "c1"), ("dns", "c2", "c2"), ("smb", "c1", "c1"), ("smb", "c2", "c1")}
    assert {(r.service, r.cls, r.ip, r.clients) for r in providers.collect()} == {
        ("dns", "c1", "10.0.0.1", 1), ("dns", "c1", "10.0.0.2", 1), ("dns", "c2", "10.0.0.1", 1), ("dns", "c2", "10.0.0.3", 1),
        ("smb", "c1", "10.0.0.1", 2), ("smb", "c1", "10.0.0.2", 2)}


def test_alternates_share_a_client(spark):
    pairs = set(_service_pairs())
    want = defaultdict(set)
    for a in pairs:
        for b in pairs:
            if a[0] == b[0] and a[2] == b[2] and a[1] != b[1]:
                want[a[1:]].add(f"{b[1]}:{b[2]}")
    got = {(r.ip, r.port): set(r.alternate_providers) for r in authority.alternate_providers(_edges(spark, pairs)).collect()}
    assert got == dict(want) and len(got) == 6
