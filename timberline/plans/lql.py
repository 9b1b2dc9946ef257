"""LQL: filters, time windows, sequences and correlations over events, compiled to DataFrames.

    query := seq [ 'during' '[' time ',' time ']' ]
    seq   := or ( 'then' or )* [ 'within' duration [ 'across' ] ]
    or    := and ( 'or' and )*      and := not ( 'and' not )*
    not   := 'not' not | '(' seq ')' | 'correlate' 'by' field '(' or ( ',' or )+ ')' 'within' duration | predicate
    predicate := field op value     op := = != < <= > >= contains matches | in '(' value, ... ')'
    field := template_id severity text time stream fingerprint attr.<key>

An unknown severity fails every ordered comparison, and ``not`` is two-valued. ``then``
gives the last step's event with its nearest earlier match of the step before in the same stream, or with ``across`` in any.
Window ends are inclusive. ParseError and ValidationError come before any plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators import enrich


class QueryError(ValueError):
    pass


class ParseError(QueryError):
    pass


class ValidationError(QueryError):
    pass


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Bool:
    op: str
    terms: tuple


@dataclass(frozen=True)
class Sequence:
    steps: tuple
    micros: int | None
    across: bool = False


@dataclass(frozen=True)
class Correlate:
    field: str
    terms: tuple
    micros: int


@dataclass(frozen=True)
class During:
    of: object
    begin: datetime
    end: datetime


_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[()\[\],])|(?P<word>[A-Za-z0-9_.:+\-]+))""")
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_ORDERED, _EQUAL, _TEXT = {"<", "<=", ">", ">="}, {"=", "!=", "in"}, {"contains", "matches"}
#: Which operators a field takes.
FIELDS = {"template_id": _EQUAL | _ORDERED, "severity": _EQUAL | _ORDERED, "text": _EQUAL | _TEXT, "time": _EQUAL | _ORDERED, "stream": _EQUAL | _TEXT, "fingerprint": _EQUAL, "attr": _EQUAL | _TEXT | _ORDERED}
_KEYWORDS = {"and", "or", "not", "then", "within", "across", "during", "correlate", "by", "in", "contains", "matches"}


class _Parser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ParseError(f"cannot read {source[at : at + 20]!r} at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].lower() in words

    def next(self, what: str = "more") -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ParseError(f"{what} is missing at the end")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> str:
        if not self.peek(*words):
            raise ParseError(f"{' or '.join(words)} is missing" + (f" before {self.tokens[self.at][1]!r}" if self.at < len(self.tokens) else " at the end"))
        return self.next()[1].lower()

    def query(self):
        out = self.sequence()
        if self.peek("during"):
            self.next()
            self.take("[")
            begin = _time(self.next("a time")[1])
            self.take(",")
            end = _time(self.next("a time")[1])
            self.take("]")
            out = During(out, begin, end)
        if self.at < len(self.tokens):
            raise ParseError(f"{self.tokens[self.at][1]!r} is too much")
        return out

    def sequence(self):
        steps = [self.any_of()]
        while self.peek("then"):
            self.next()
            steps.append(self.any_of())
        micros, across = None, False
        if self.peek("within"):
            self.next()
            micros = _duration(self.next("a duration")[1])
            if len(steps) == 1:
                raise ParseError("within needs then")
            if self.peek("across"):
                self.next()
                across = True
        return steps[0] if len(steps) == 1 else Sequence(tuple(steps), micros, across)

    def _chain(self, word: str, part):
        terms = [part()]
        while self.peek(word):
            self.next()
            terms.append(part())
        return terms[0] if len(terms) == 1 else Bool(word, tuple(terms))

    def any_of(self):
        return self._chain("or", self.all_of)

    def all_of(self):
        return self._chain("and", self.one)

    def one(self):
        if self.peek("not"):
            self.next()
            return Not(self.one())
        if self.peek("("):
            self.next()
            out = self.sequence()
            self.take(")")
            return out
        if self.peek("correlate"):
            self.next()
            self.take("by")
            field = self.next("a field")[1]
            self.take("(")
            terms = [self.any_of()]
            while self.peek(","):
                self.next()
                terms.append(self.any_of())
            self.take(")")
            self.take("within")
            if len(terms) < 2:
                raise ParseError("correlate needs two terms")
            return Correlate(field, tuple(terms), _duration(self.next("a duration")[1]))
        kind, field = self.next("a field")
        if kind != "word" or field.lower() in _KEYWORDS:
            raise ParseError(f"a field is missing before {field!r}")
        op = self.next("an operator")[1].lower()
        if op not in _ORDERED | _EQUAL | _TEXT:
            raise ParseError(f"{op!r} is no operator")
        if op != "in":
            return Predicate(field, op, self.value())
        self.take("(")
        values = [self.value()]
        while self.peek(","):
            self.next()
            values.append(self.value())
        self.take(")")
        return Predicate(field, op, tuple(values))

    def value(self) -> str:
        kind, v = self.next("a value")
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind != "word":
            raise ParseError(f"a value is missing before {v!r}")
        return v


def _duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text)
    if not m:
        raise ParseError(f"{text!r} is no duration")
    return int(m[1]) * _UNITS[m[2]]


def _time(text: str) -> datetime:
    try:
        return datetime.fromisoformat(text.strip("\"'").replace("Z", ""))
    except ValueError as e:
        raise ParseError(f"{text!r} is no time") from e


def parse(source: str):
    """The syntax tree of a query."""
    return _Parser(source).query()


def validate(node) -> None:
    """Fields, operators, values and bounds, before anything is planned."""
    if isinstance(node, Predicate):
        base = "attr" if node.field.startswith("attr.") and len(node.field) > 5 else node.field
        if base not in FIELDS or node.field == "attr":
            raise ValidationError(f"unknown field {node.field!r}")
        if node.op not in FIELDS[base]:
            raise ValidationError(f"{node.field} does not take {node.op!r}")
        for v in node.value if isinstance(node.value, tuple) else (node.value,):
            if base == "severity" and v not in (*enrich.LEVELS, "unknown") or base == "severity" and v == "unknown" and node.op in _ORDERED:
                raise ValidationError(f"{v!r} is no severity here")
            if base == "template_id" and not re.fullmatch(r"-?\d+", v):
                raise ValidationError(f"{v!r} is no template_id")
            if base == "time":
                _time(v)
            if node.op == "matches":
                try:
                    re.compile(v)
                except re.error as e:
                    raise ValidationError(f"{v!r} is no regular expression") from e
    elif isinstance(node, Not):
        validate(node.of)
        if _temporal(node.of):
            raise ValidationError("not takes no sequence or correlation")
    elif isinstance(node, Bool | Sequence | Correlate):
        for t in node.terms if not isinstance(node, Sequence) else node.steps:
            validate(t)
            if _temporal(t) and not isinstance(node, Bool):
                raise ValidationError("sequences and correlations do not nest")
        if isinstance(node, Bool) and any(map(_temporal, node.terms)) and (node.op == "or" or sum(map(_temporal, node.terms)) > 1):
            raise ValidationError("a sequence or correlation joins filters by and, one a query")
        if isinstance(node, Correlate) and node.field not in FIELDS and not node.field.startswith("attr."):
            raise ValidationError(f"unknown field {node.field!r}")
    elif isinstance(node, During):
        if node.begin > node.end:
            raise ValidationError("the window ends before it begins")
        validate(node.of)


def _temporal(node) -> bool:
    return isinstance(node, Sequence | Correlate) or (isinstance(node, Bool) and any(map(_temporal, node.terms))) or (isinstance(node, Not | During) and _temporal(node.of))


def _field(name: str) -> Column:
    if name.startswith("attr."):
        return enrich.attribute(F.col("attributes"), name[5:])
    return {"template_id": F.col("template_id"), "severity": F.col("severity"), "text": F.col("raw"), "time": F.col("time"), "stream": F.col("stream_id"), "fingerprint": F.col("fingerprint")}[name]


def _compare(c: Column, op: str, v) -> Column:
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def column(node) -> Column:
    """A filter as a Column; leaves stay plain comparisons, so that they reach the scan."""
    if isinstance(node, Predicate):
        f, op, v = _field(node.field), node.op, node.value
        if op == "contains":
            return f.contains(v)
        if op == "matches":
            return f.rlike(v)
        if node.field == "severity":
            one = lambda x: f.isNull() if x == "unknown" else f == x
            if op == "in":
                out = one(v[0])
                for x in v[1:]:
                    out = out | F.coalesce(one(x), F.lit(False))
                return F.coalesce(out, F.lit(False))
            if op in _ORDERED:
                return _compare(enrich.rank(f), op, enrich.LEVELS.index(v))
            return one(v) if op == "=" else ~F.coalesce(one(v), F.lit(False))
        if node.field in ("template_id", "fingerprint"):
            v = tuple(map(int, v)) if isinstance(v, tuple) else int(v) if node.field == "template_id" or re.fullmatch(r"-?\d+", v) else v
        if node.field == "time":
            v = tuple(map(_time, v)) if isinstance(v, tuple) else _time(v)
            lit = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
            return f.isin(*map(lit, v)) if op == "in" else _compare(f, op, lit(v))
        if node.field.startswith("attr.") and op in _ORDERED:
            number = re.fullmatch(r"-?\d+(\.\d+)?", v)
            return _compare(f.try_cast("double"), op, float(v)) if number else _compare(f, op, v)
        return f.isin(*v) if op == "in" else _compare(f, op, v)
    if isinstance(node, Not):
        return ~F.coalesce(column(node.of), F.lit(False))
    if isinstance(node, Bool):
        out = column(node.terms[0])
        for t in node.terms[1:]:
            out = out & column(t) if node.op == "and" else out | column(t)
        return out
    raise ValidationError(f"{type(node).__name__} is no filter")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _sequence(events: DataFrame, node: Sequence) -> DataFrame:
    """Chained look-back by running maxima: for each step the time of the nearest complete earlier match."""
    flags = {f"__s{k}": F.coalesce(column(s), F.lit(False)) for k, s in enumerate(node.steps)}
    some = F.lit(False)
    for c in flags.values():
        some = some | c
    rows = events.filter(some).withColumns(flags)
    before = Window.partitionBy("stream_id").orderBy("time", "source_offset").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("__s0"), F.struct("time", "source_offset"))
    for k in range(1, len(node.steps)):
        rows = rows.withColumn(f"__m{k - 1}", last).withColumn(f"__b{k}", F.last(f"__m{k - 1}", ignorenulls=True).over(before))
        ok = F.col(f"__s{k}") & F.col(f"__b{k}").isNotNull()
        if node.micros is not None:
            ok = ok & (_micros("time") - F.unix_micros(F.col(f"__b{k}.time").cast("timestamp")) <= node.micros)
        last = F.when(ok, F.struct("time", "source_offset"))
        if k == len(node.steps) - 1:
            rows = rows.filter(ok)
    k = len(node.steps) - 1
    return rows.select(*events.columns, F.col(f"__b{k}.source_offset").alias("previous_offset"), F.col(f"__b{k}.time").alias("previous_time"))


def _sequence_across(events: DataFrame, node: Sequence) -> DataFrame:
    """The same over all streams together, in order of time, stream and offset. Pieces of time as long as the window hold each
    match twice, in their own piece and the next, so that no task sees more than two windows."""
    order = ["time", "stream_id", "source_offset"]
    piece = F.floor(_micros("time") / node.micros)
    found = events.filter(F.coalesce(column(node.steps[0]), F.lit(False))).select(*order)
    for k, step in enumerate(node.steps[1:], 1):
        last = k == len(node.steps) - 1
        rows = events.filter(F.coalesce(column(step), F.lit(False)))
        rows = rows.select(*order, piece.alias("__piece"), F.struct(*events.columns).alias("__row"), F.lit(None).cast(found.select(F.struct("time", "source_offset").alias("x")).schema["x"].dataType).alias("__hit"))
        hits = found.select(*order, F.explode(F.array(piece, piece + 1)).alias("__piece"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct("time", "source_offset").alias("__hit"))
        before = Window.partitionBy("__piece").orderBy(*order, F.col("__row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
        both = rows.unionByName(hits).withColumn("__before", F.last("__hit", ignorenulls=True).over(before)).filter("__row is not null and __before is not null")
        both = both.filter(_micros("time") - F.unix_micros(F.col("__before.time").cast("timestamp")) <= node.micros)
        if last:
            return both.select("__row.*", F.col("__before.source_offset").alias("previous_offset"), F.col("__before.time").alias("previous_time"))
        found = both.select(*order)


def _correlate(events: DataFrame, node: Correlate) -> DataFrame:
    """Events of one key with gaps of at most W make a group; groups that hold every term stay."""
    flags = {f"__t{k}": F.coalesce(column(t), F.lit(False)) for k, t in enumerate(node.terms)}
    some = F.lit(False)
    for c in flags.values():
        some = some | c
    rows = events.withColumn("__key", _field(node.field).cast("string")).filter(F.col("__key").isNotNull() & some).withColumns(flags)
    order = Window.partitionBy("__key").orderBy("time", "stream_id", "source_offset")
    opens = F.coalesce(_micros("time") - F.lag(_micros("time")).over(order) > node.micros, F.lit(True))
    rows = rows.withColumn("__opens", opens.cast("int")).withColumn("group", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = rows.groupBy("__key", "group").agg(*(F.max(c).alias(c) for c in flags))
    for c in flags:
        full = full.filter(c)
    return rows.join(full.select("__key", "group"), ["__key", "group"], "left_semi").select(*events.columns, F.col("__key").alias("correlation_key"), F.col("group").cast("bigint").alias("correlation_group"))


def _apply(events: DataFrame, node) -> DataFrame:
    if isinstance(node, During):
        lit = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        return _apply(events.filter(F.col("time").between(lit(node.begin), lit(node.end))), node.of)
    if isinstance(node, Sequence):
        return _sequence_across(events, node) if node.across else _sequence(events, node)
    if isinstance(node, Correlate):
        return _correlate(events, node)
    if isinstance(node, Bool) and _temporal(node):
        # the other terms scope what the temporal one sees
        for t in node.terms:
            if not _temporal(t):
                events = events.filter(column(t))
        return _apply(events, next(t for t in node.terms if _temporal(t)))
    return events.filter(column(node))


def run(events: DataFrame, source: str) -> DataFrame:
    """The events that a query finds. ``events`` has stream_id, source_offset, raw, severity, template_id, fingerprint,
    attributes and time (or event_time and ingestion_time) as far as the query asks."""
    node = parse(source)
    validate(node)
    if "time" not in events.columns:
        events = events.withColumn("time", enrich.order_time())
    return _apply(events, node)


def bounds(node) -> tuple[datetime | None, datetime | None]:
    """The time window that the whole query stays in, for pruning segments."""
    return (node.begin, node.end) if isinstance(node, During) else (None, None)


def viewport(events: DataFrame, *, anchor: tuple[str, int] | None = None, size: int, follow_tail: bool = False) -> DataFrame:
    """A page of ``size`` events from an anchor (stream, offset), or the last ones."""
    order = ["stream_id", "source_offset"]
    if follow_tail:
        return events.orderBy(*(F.desc(c) for c in order)).limit(size)
    if anchor:
        s, o = anchor
        events = events.filter((F.col("stream_id") > s) | ((F.col("stream_id") == s) & (F.col("source_offset") >= o)))
    return events.orderBy(*order).limit(size)


def fuzzy_rank(rows: DataFrame, needle: str, *, column: str, size: int = 20) -> DataFrame:
    """Rows whose text holds the needle's characters in order, by the span of the first such match, then length, then text."""
    # the first of each character behind the one before: a text is made once and gone through once, whatever it holds
    def step(text: Column, held: Column, c: Column) -> Column:
        at = F.position(c, text, held["at"] + 1)
        return F.when(held["at"] < 0, held).otherwise(F.struct(F.when(held["begin"] == 0, at).otherwise(held["begin"]).alias("begin"), F.when(at == 0, -1).otherwise(at).alias("at")))

    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("at"))
    find = lambda text: F.aggregate(F.array(*map(F.lit, needle.lower())), start, lambda held, c: step(text, held, c), lambda held: F.when(held["at"] > 0, held["at"] - held["begin"] + 1))
    span = F.element_at(F.transform(F.array(F.lower(F.col(column))), find), 1) if needle else F.length(F.substring(column, 1, 0))
    # a filter before the limit would go below what makes the text, and make it twice
    return rows.withColumn("score", span.cast("bigint")).orderBy(F.asc_nulls_last("score"), F.length(column), column).limit(size).filter("score is not null")
