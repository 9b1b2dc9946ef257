import itertools
import random

from pyspark.sql import functions as F

from timberline.llm import urls
from timberline.llm.queries import URL_RULES

CASES = [
    (None, "", "", None),
    ("no scheme/at all", "", "", None),
    ("http://A.Example.COM/en/1?x=1#y", "a.example.com", "/en/1", "example.com/en/"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("https://m.www.example.com/en/2", "m.www.example.com", "/en/2", "www.example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("http://x.net/es/9", "x.net", "/es/9", "net/es/"),
    ("http://x.net/esp", "x.net", "/esp", None),
    ("http://com", "com", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("://h.com/", "h.com", "/", "com/"),
    ("http://ÀB.com/x\ny?z", "Àb.com", "/x\ny", "com/"),
    ("", "", "", None),
]


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.split(df, URL_RULES, keep=["page_id"]).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        t = sorted({rng.choice("abcdef") for _ in range(rng.randrange(1, 5))})
        rows.append((t, "block" if "a" in t and ("b" in t or rng.random() < 0.5) else "allow" if rng.random() < 0.9 else None))
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.05, min_confidence=0.7)
    labelled = [(set(t), y) for t, y in rows if y]
    want = {}
    for k in range(1, 7):
        for left in itertools.combinations("abcdef", k):
            n = sum(set(left) <= t for t, _ in labelled)
            for y in ("allow", "block"):
                both = sum(set(left) <= t and y == z for t, z in labelled)
                if both >= 0.05 * len(labelled) and both / n >= 0.7:
                    want[left, y] = both / n
    # the pruned ones are those that a subset makes as surely
    kept = {(left, y): c for (left, y), c in want.items() if not any(z == y and set(s) < set(left) and d >= c for (s, z), d in want.items())}
    assert {(m[0], m[1]): round(m[2], 9) for m in mined} == {k: round(c, 9) for k, c in kept.items()}


def test_surest_rule_decides():
    rules = urls.MinedRules([(("a",), "allow", 0.9, 0.5), (("a", "b"), "block", 0.95, 0.1), (("c",), "allow", 0.95, 0.2)])
    assert rules.surest(["a"]) == (("a",), "allow") and rules.surest(["a", "b"])[1] == "block"
    assert rules.surest(["a", "b", "c"])[1] == "allow" and rules.surest(["x"]) is None and rules.surest([]) is None


def test_verdicts_and_empty(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")
    parts = urls.split(df, URL_RULES, keep=["page_id"])
    assert urls.mine(parts.filter("false").select("tokens", F.col("ruled").alias("label"))) == []
    got = {r.page_id: r.verdict for r in urls.verdicts(parts, [], keep=["page_id"]).collect()}
    assert got[0] == "allow" and got[2] == "block" and got[3] == "allow" and got[6] == "block"
    assert urls.verdicts(parts.limit(0), [], keep=["page_id"]).count() == 0


def test_long_parts_differ_after_64_characters():
    long = "a" * 64
    one, two = (urls.tokens(f"https://x.com/{long}{c}?{long}{c}=1", "x.com", f"/{long}{c}") for c in "bc")
    assert not {t for t in one if t[:2] in ("p:", "q:")} & {t for t in two if t[:2] in ("p:", "q:")}
    assert f"p:{long}" in urls.tokens(f"https://x.com/{long}", "x.com", f"/{long}")


def test_many_common_tokens_are_one_and_raise_the_support(spark):
    """Forty tokens that all URLs share would have 2^40 combinations, and so would forty that nearly all do."""
    common = [f"p:{k}" for k in range(40)]
    rows = [([*common, "h:bad"], "block")] * 30 + [([*common, "h:good"], "allow")] * 70
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(("h:bad",), "block"), (("h:good",), "allow")} == {(m[0], m[1]) for m in found}
    rows += [([f"p:{k}"], "allow") for k in range(40)]
    items = spark.createDataFrame([([*t, "=" + y],) for t, y in rows], "items array<string>")
    assert urls.bounded(items, 0.005, 20)[1] > 100 / 140
    assert all(len(m[0]) < 2 for m in urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string")))
    assert len(urls.mine(spark.createDataFrame([(t[36:], y) for t, y in rows], "tokens array<string>, label string"), most_rules=2)) <= 2


def test_held_out_labels_and_rows_as_they_come(spark):
    """Rules mined from four fifths of the URLs judge the others as their labels do; long, repeated and null URLs are rows like others."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        tld, lang, shop = rng.choice(["com", "net", "org"]), rng.choice(["en", "fr", "es"]), rng.random() < 0.3
        bad = (tld == "net" and lang != "en") or (tld == "org" and shop)
        rows.append((i, f"https://www.site{rng.randrange(9)}.{tld}/{lang}/{'shop/' if shop else ''}{rng.randrange(99)}?id={i}", "block" if bad else "allow"))
    rows += [(2000, "https://x.org/" + "a" * 100_000 + "/shop/", None), (2001, None, None), (2001, None, None), (2001, "https://x.net/fr/?" + "q=1&" * 2000, None)]
    parts = urls.split(spark.createDataFrame(rows, "page_id long, url string, label string"), [], keep=["page_id", "label"])
    mined = urls.mine(parts.filter("page_id % 5 <> 2").select("tokens", "label"))
    got = urls.verdicts(parts, mined, keep=["page_id", "label"]).collect()
    held = [r for r in got if r.page_id % 5 == 2 and r.label]
    assert len(got) == len(rows) and sum(r.verdict == r.label for r in held) >= 0.95 * len(held)
    assert [r.verdict for r in got if r.page_id == 2000] == ["block"] and sorted(r.verdict for r in got if r.page_id == 2001) == ["allow", "allow", "block"]


def test_no_rule_is_dropped_beyond_the_bounds(spark):
    """Two tokens of forty make the rule; with the bounds of FP-growth, by search and broadcast, and by search and join all URLs get the verdict of brute force."""
    rng = random.Random(5)
    common = [f"p:{k:02}" for k in range(22)]
    rows = [([*common, "h:bad"], "block")] * 30 + [([*common, "h:good"], "allow")] * 70
    for _ in range(300):
        t = sorted({rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))})
        rows.append((t, "block" if "a" in t and ("b" in t or rng.random() < 0.5) else "allow" if rng.random() < 0.8 else None))
    small = [(t, y) for t, y in rows if len(t) < 20]
    asked = [*({tuple(t) for t, _ in small}), ("h:bad",), ("h:good", "z"), ("p:03", "p:07"), ("a", "p:01"), ("z",), ()]

    def brute(labelled, t):
        n, best = len(labelled), None
        for k in range(1, len(t) + 1):
            for left in itertools.combinations(t, k):
                held = [y for s, y in labelled if set(left) <= s]
                for y in ("allow", "block"):
                    both = held.count(y)
                    if both >= 0.02 * n and both / len(held) >= 0.7:
                        rank = (both / len(held), both / n, y == "block", -k, left)
                        best = max(best, rank) if best else rank
        return ("block" if best[2] else "allow", ",".join(best[4])) if best else ("allow", None)

    for given in (small, rows):
        labelled = [(set(t), y) for t, y in given if y]
        df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(given)] + [(10_000 + i, list(t), None) for i, t in enumerate(asked)], "k int, tokens array<string>, ruled string")
        want = {10_000 + i: brute(labelled, t) for i, t in enumerate(asked)}
        assert len(set(want.values())) > 5
        for bounds in ({}, {"most_tokens": 3}, {"most_tokens": 3, "most_rules": 2}):
            got = {r.k: (r.verdict, r.mined_rule) for r in urls.judged(df, keep=["k"], min_support=0.02, min_confidence=0.7, **bounds).collect()}
            assert len(got) == len(given) + len(asked) and {k: got[k] for k in want} == want, bounds
            assert all(got[i][0] == y for i, (_, y) in enumerate(given) if y)


def test_a_token_of_all_labelled_urls_judges_alone(spark):
    """A URL may have one of the tokens that all labelled ones share, and not the other."""
    rows = [(k, ["p:x", "p:y"], "block", "x") for k in range(9)] + [(9, ["p:y"], None, "x"), (10, ["p:x"], None, "x")]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, ruled string, x string")
    assert {r.k: r.verdict for r in urls.judged(df, keep=["k"]).collect() if r.k > 8} == {9: "block", 10: "block"}
