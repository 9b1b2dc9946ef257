"""URL filters: host and path rules, and association rules mined from labelled URLs.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's; the longest rule wins. URLs that no rule fits are
judged by mined rules. Spark's FP-growth mines combinations of URL tokens together with
the label of labelled URLs; rules token set -> label are pruned by support and
confidence, and those go that a smaller set makes with at least their confidence.
Rules are matched by an inverted index from each rule's rarest token. Of the mined rules
that match, the surest decides (then the better supported, ``block``, the one of fewer tokens, the last by name); a URL
without any gets ``otherwise``.

``judged`` drops no rule. FP-growth lists all combinations, so it is taken where no labelled URL has more than
``most_tokens`` frequent tokens (k of them have 2^k combinations) and where it gives at most ``most_rules`` rules. Beyond
either, ``searched`` grows sets on the conditional rows of each set's rarest token, a task a token, and leaves
out what cannot decide: sets that hold of the same labelled URLs as a smaller one, sets that no surer one can come from, and rules
that a smaller set makes as surely. Up to ``most_rules`` rules are broadcast; more stay a table and are joined
by their rarest token. ``mine`` alone is the bounded form: it raises the support until FP-growth's rules fit.

Defined results: a null URL, or one without ``://``, has empty host and path and no
tokens but these; repeated rows give repeated results; with no labelled URL nothing is
mined; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.cluster import lean, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "="


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class RuleList:
    """Rules (verdict, "host/path") by host; ``find`` gives the longest that fits."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            name, slash, rest = rule.partition("/")
            self.by_host.setdefault(name, []).append((slash + rest, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


def _whole(part: str) -> str:
    """The part, or beyond 64 characters its start and a hash of all of it: 65 characters, so no shorter part is spelt like it."""
    return part if len(part) <= 64 else f"{part[:32]}~{blake2b(part.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def tokens(url: str | None, host: str, path: str) -> list[str]:
    """Distinct tokens of a URL: top domain, host labels with their words, path parts with numbers made alike, query keys, fragment."""
    names = host.split(".") if host else []
    out = [f"t:{names[-1]}"] if names else []
    out += [f"h:{x}" for name in names[:-1] for x in {name, *name.split("-")} if x]
    for part in path.split("/"):
        if part:
            out.append("p:" + _whole(re.sub(r"\d+", "#", part)))
    tail = (url or "").partition("?")[2]
    out += [f"q:{_whole(p.partition('=')[0])}" for p in tail.partition("#")[0].split("&") if p]
    if "#" in (url or ""):
        out.append("f")
    return sorted(set(out))


def split(pages: DataFrame, rules: list[tuple[str, str]], *, keep: list[str], url: str = "url") -> DataFrame:
    """The columns ``keep``, and host, path, tokens, rule and ruled (the rule's verdict) of each URL."""
    keep = [c for c in keep if c not in {"host", "path", "tokens", "rule", "ruled"}]
    rows = pages.select(*keep, F.col(url).alias("__url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = RuleList(rules)
        for batch in batches:
            urls, hosts, paths = (batch.column(c).to_pylist() for c in ("__url", "host", "path"))
            found = [listed.find(h, p) if h or p else None for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in (*keep, "host", "path")),
                    pa.array([tokens(u, h, p) for u, h, p in zip(urls, hosts, paths, strict=True)], pa.list_(pa.string())),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f and f[1] for f in found], pa.string()),
                ],
                names=[*keep, "host", "path", "tokens", "rule", "ruled"],
            )

    none = F.lit(None).cast("string")
    schema = rows.select(*keep, "host", "path", F.array(none).alias("tokens"), none.alias("rule"), none.alias("ruled")).schema
    return rows.mapInArrow(lean(judge), schema)


def bounded(items: DataFrame, min_support: float, most_tokens: int) -> tuple[DataFrame, float]:
    """``items`` without those that every row has, but for one (they say the same), and ``min_support`` or what more it
    takes for no row to have more than ``most_tokens`` frequent items."""
    n = items.count()
    # at most (items a row) / min_support of them
    counts = {r["item"]: r["n"] for r in items.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support * n).collect()}
    alike = sorted(t for t, k in counts.items() if k == n and not t.startswith(_LABEL))[1:]
    if alike:
        items = items.select(F.array_except("items", F.array(*map(F.lit, alike))).alias("items"))
    held = items.sparkSession.sparkContext.broadcast(counts)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            for row in batch.column(0).to_pylist():
                found = sorted((held.value[t] for t in row if t in held.value), reverse=True)
                most = max(most, found[most_tokens]) if len(found) > most_tokens else most
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], names=["n"])

    most = items.mapInArrow(lean(beyond), "n bigint").agg(F.max("n")).first()[0] or 0
    return items, max(min_support, (most + 1) / n) if most else min_support


def _items(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("label").isNotNull()).select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))


def _grown(items: DataFrame, support: float, min_confidence: float) -> DataFrame:
    """FP-growth's rules with a label on the right alone, written."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    return materialize(model.associationRules.filter(F.element_at("consequent", 1).startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL))), "url-rules")


def _pruned(rules: DataFrame) -> list[tuple[tuple[str, ...], str, float, float]]:
    kept: dict[tuple[frozenset, str], tuple[float, float]] = {}
    for r in sorted(rules.collect(), key=lambda r: (len(r["antecedent"]), sorted(r["antecedent"]), r["consequent"][0])):
        left, label = frozenset(r["antecedent"]), r["consequent"][0][len(_LABEL) :]
        smaller = (kept.get((left - {t}, label)) for t in left)
        best = max((s[0] for s in smaller if s), default=0.0)
        # what a smaller rule says as surely goes, but its confidence is handed on
        kept[left, label] = (max(best, r["confidence"]), r["support"] if r["confidence"] > best else -1.0)
    return [(tuple(sorted(left)), label, c, s) for (left, label), (c, s) in kept.items() if s >= 0]


def mine(labelled: DataFrame, *, min_support: float = 0.005, min_confidence: float = 0.8, most_tokens: int = 20, most_rules: int = 200_000) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, label, confidence, support) of the pruned rules; ``labelled`` has tokens and label. Bounded by raising the support."""
    items = _items(labelled)
    if items.isEmpty():
        return []
    items, support = bounded(items, min_support, most_tokens)
    while support <= 1:
        rules = _grown(items, support, min_confidence)
        if rules.count() <= most_rules:
            return _pruned(rules)
        support *= 2
    return []


def _search(names: list[str], labels: list[str], n: int, least: int, min_confidence: float):
    """Over rows (rarest, others, label, n) sorted by rarest, tokens and labels as numbers: the rules (rarest, left, label, confidence, support)."""
    schema = pa.schema([("rarest", pa.string()), ("left", pa.list_(pa.string())), ("label", pa.string()), ("confidence", pa.float64()), ("support", pa.float64())])

    def grow(left: tuple, row: np.ndarray, item: np.ndarray, weight: np.ndarray, best: np.ndarray) -> Iterator[tuple]:
        """``row`` and ``item``: the tokens that may join ``left``, by row; ``weight``: rows by labels; ``best``: the surest so far on the way here."""
        each = weight.sum(axis=0)
        total = each.sum()
        sure = each / total
        for k in np.flatnonzero((each >= least) & (sure >= min_confidence) & (sure > best)):
            yield (names[left[0]], sorted(names[t] for t in left), labels[k], float(sure[k]), float(each[k] / n))
        if not len(item) or each.max() == total:
            return
        best = np.where(each >= least, np.maximum(best, sure), best)
        counts = np.stack([np.bincount(item, weights=weight[row, k]) for k in range(len(labels))])
        # a token that all rows have makes the same rules
        alive = (counts.max(axis=0) >= least) & (counts.sum(axis=0) < total)
        keep = alive[item]
        row, item = row[keep], item[keep]
        for t in np.flatnonzero(alive)[::-1]:
            at = np.full(len(weight), -1)
            have = row[item == t]
            at[have] = np.arange(len(have))
            inner = (at[row] >= 0) & (item < t)
            yield from grow((*left, t), at[row[inner]], item[inner], weight[have], best)

    def group(rarest: int, rows: dict[tuple, list[int]]) -> Iterator[tuple]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        item = np.fromiter((t for r in rows for t in r), np.int64, int(sizes.sum()))
        yield from grow((rarest,), np.repeat(np.arange(len(rows)), sizes), item, np.array(list(rows.values()), np.float64), np.zeros(len(labels)))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, rows = None, {}
        for batch in batches:
            for rarest, others, label, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rarest != now:
                    if rows:
                        yield from group(now, rows)
                    now, rows = rarest, {}
                rows.setdefault(tuple(others), [0] * len(labels))[label] += count
        if rows:
            yield from group(now, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rule in groups(batches):
            out.append(rule)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def searched(items: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """rarest, left, label, confidence and support of all rules that can be a URL's surest, written; no bound on tokens or rules."""
    spark, n = items.sparkSession, items.count()
    least = max(1, math.ceil(min_support * n))
    counts = items.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()
    # the most frequent first; at most (items a row) / min_support
    names = [r["item"] for r in sorted(counts, key=lambda r: (-r["n"], r["item"])) if not r["item"].startswith(_LABEL)]
    label = F.substring(F.filter("items", lambda t: t.startswith(_LABEL))[0], len(_LABEL) + 1, 1 << 30)
    labels = sorted(r[0] for r in items.select(label).distinct().collect())
    held = spark.sparkContext.broadcast(({t: k for k, t in enumerate(names)}, {y: k for k, y in enumerate(labels)}))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, label_of = held.value
        for batch in batches:
            sets = [sorted({of[t] for t in row if t in of}) for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), pa.array([label_of[y] for y in batch.column(1).to_pylist()], pa.int32())], names=["tokens", "label"])

    rows = items.select("items", label.alias("label")).mapInArrow(lean(numbered), "tokens array<int>, label int").groupBy("tokens", "label").agg(F.count("*").alias("n"))
    rows = rows.select("tokens", "label", "n", F.posexplode("tokens").alias("at", "rarest")).select("rarest", F.slice("tokens", F.lit(1), F.col("at")).alias("others"), "label", "n")
    rows = rows.groupBy("rarest", "others", "label").agg(F.sum("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "rarest").sortWithinPartitions("rarest").mapInArrow(lean(_search(names, labels, n, least, min_confidence)), "rarest string, left array<string>, label string, confidence double, support double")
    return materialize(rows, "url-search")


def all_rules(labelled: DataFrame, *, min_support: float = 0.005, min_confidence: float = 0.8, most_tokens: int = 20, most_rules: int = 200_000) -> list[tuple[tuple[str, ...], str, float, float]] | DataFrame:
    """All rules that can decide: a list as of ``mine`` if there are at most ``most_rules``, else the table of ``searched``."""
    every = _items(labelled)
    if every.isEmpty():
        return []
    items, support = bounded(every, min_support, most_tokens)
    if support == min_support and (rules := _grown(items, support, min_confidence)).count() <= most_rules:
        return _pruned(rules) + _alike(every, min_confidence)
    rules = searched(every, min_support, min_confidence)
    if rules.count() > most_rules:
        return rules
    return [(tuple(r["left"]), r["label"], r["confidence"], r["support"]) for r in rules.collect()]


def _alike(items: DataFrame, min_confidence: float) -> list[tuple[tuple[str, ...], str, float, float]]:
    """The rules of the tokens that ``bounded`` takes out: every labelled URL has them, so each says alone what the labels' shares say."""
    n = items.count()
    counts = {r["item"]: r["n"] for r in items.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter((F.col("n") == n) | F.col("item").startswith(_LABEL)).collect()}
    alike = sorted(t for t, k in counts.items() if k == n and not t.startswith(_LABEL))[1:]
    sure = [(t[len(_LABEL) :], k / n) for t, k in counts.items() if t.startswith(_LABEL) and k / n >= min_confidence]
    return [((t,), label, share, share) for t in alike for label, share in sure]


class MinedRules:
    """Inverted index over the rules; ``surest`` gives the deciding rule of a token set."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]]):
        seen: dict[str, int] = {}
        for left, *_ in rules:
            for t in left:
                seen[t] = seen.get(t, 0) + 1
        self.index: dict[str, list[tuple[frozenset, tuple, tuple, str]]] = {}
        for left, label, confidence, support in rules:
            rarest = min(left, key=lambda t: (seen[t], t))
            self.index.setdefault(rarest, []).append((frozenset(left), (confidence, support, label == "block", -len(left), left), left, label))

    def surest(self, tokens: list[str]) -> tuple[tuple[str, ...], str] | None:
        have, best = set(tokens), None
        for t in tokens:
            for left, rank, names, label in self.index.get(t, ()):
                if left <= have and (best is None or rank > best[0]):
                    best = (rank, names, label)
        return best and best[1:]


def verdicts(parts: DataFrame, mined: list[tuple], *, keep: list[str], otherwise: str = "allow") -> DataFrame:
    """``keep`` of the split URLs, with verdict and mined_rule (the deciding tokens, comma-joined, or null)."""
    held = parts.sparkSession.sparkContext.broadcast(mined)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = MinedRules(held.value)
        for batch in batches:
            ruled, sets = batch.column("ruled").to_pylist(), batch.column("tokens").to_pylist()
            best = [None if r else rules.surest(t) for r, t in zip(ruled, sets, strict=True)]
            verdict = [r or (b[1] if b else otherwise) for r, b in zip(ruled, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(verdict, pa.string()), pa.array([b and ",".join(b[0]) for b in best], pa.string())], names=[*keep, "verdict", "mined_rule"])

    none = F.lit(None).cast("string")
    need = [*dict.fromkeys([*keep, "tokens", "ruled"])]
    return parts.select(*need).mapInArrow(lean(judge), parts.select(*keep, none.alias("verdict"), none.alias("mined_rule")).schema)


def joined_verdicts(parts: DataFrame, rules: DataFrame, *, keep: list[str], otherwise: str = "allow") -> DataFrame:
    """What ``verdicts`` gives, for a table of rules: token sets meet the rules of their tokens, and the surest that fits decides."""
    sets = parts.filter("ruled IS NULL").select(F.col("tokens").alias("__tokens")).distinct()
    met = sets.select("__tokens", F.explode("__tokens").alias("rarest")).join(rules, "rarest").filter(F.size(F.array_except("left", "__tokens")) == 0)
    rank = F.struct("confidence", "support", F.col("label") == "block", -F.size("left"), "left", "label")
    best = met.groupBy("__tokens").agg(F.max(rank).alias("__best"))
    rows = parts.join(best, F.col("ruled").isNull() & (F.col("tokens") == F.col("__tokens")), "left")
    return rows.select(*keep, F.coalesce("ruled", F.col("__best.label"), F.lit(otherwise)).alias("verdict"), F.array_join("__best.left", ",").alias("mined_rule"))


def judged(parts: DataFrame, *, keep: list[str], otherwise: str = "allow", **bounds) -> DataFrame:
    """``verdicts`` of the split URLs by all rules that those judged by a given rule (``ruled``) make."""
    rules = all_rules(parts.select("tokens", F.col("ruled").alias("label")), **bounds)
    return (verdicts if isinstance(rules, list) else joined_verdicts)(parts, rules, keep=keep, otherwise=otherwise)
