"""Conversation structure repair: the cheapest edits that give a role grammar.

The grammar of role initials is ``C -> empty | T | s T``, ``T -> u a | T u a``. Its LR tables are
built here from the productions; all ways to read a conversation's rows are followed at once on a
graph-structured stack whose nodes share what lies below them. For each row every stack top may
keep it, rerole it (to user or assistant), delete it, or insert empty turns before it; equal tops
merge into the one of least (cost, audit), the audit being the edits' initials (D, I, K, R).

* Faults, of which a row's first counts: blank (no visible character), duplicate (same role and
  text as an earlier row), truncated (last visible character not one of ``.!?``). Blank and
  duplicate rows must be deleted; a truncated row that stays costs more.
* Rows of a conversation go by turn, nulls first, then role and text in byte order; so equal rows
  stand together and ties change nothing. A null conversation is one conversation. A null role or
  text counts as one blank, a row whose role is empty or of another initial cannot be kept.
* A conversation without rows left has cost 0, no edits and no turns; an empty table gives no rows.
* Input columns beside conv_id, turn, role and text are not needed and not read.

A conversation passes one task as a sorted stream: its texts are never held. Each stack top carries
its own running hash, and a byte a row and top tells later which edits led there. The one hash of
a whole repaired conversation is sequential, so no conversation is split over tasks.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, lean

#: What the grammar's symbols may become: left side, right side. Upper case stands for rules, lower case for role initials.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_VISIBLE, _ENDS = re.compile(r"[^\x20\x09-\x0D]"), ".!?"


class Tables:
    """LR(0) item sets of a grammar; a reduction is made where the next symbol can follow its rule."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, start = grammar, grammar[0][0]
        self.rules = {left for left, _ in grammar}
        self.states, self.goto, queue = [self._closed(frozenset((k, 0) for k, (left, _) in enumerate(grammar) if left == start))], {}, [0]
        for at in queue:
            for symbol in sorted({grammar[k][1][dot] for k, dot in self.states[at] if dot < len(grammar[k][1])}):
                to = self._closed(frozenset((k, dot + 1) for k, dot in self.states[at] if grammar[k][1][dot : dot + 1] == symbol))
                if to not in self.states:
                    self.states.append(to)
                    queue.append(len(self.states) - 1)
                self.goto[at, symbol] = self.states.index(to)
        self.follow = self._follow(start)

    def _closed(self, items: frozenset) -> frozenset:
        """With every rule that may begin where a dot stands."""
        while True:
            wanted = {self.grammar[k][1][dot] for k, dot in items if dot < len(self.grammar[k][1])} & self.rules
            more = items | {(k, 0) for k, (left, _) in enumerate(self.grammar) if left in wanted}
            if more == items:
                return items
            items = more

    def _follow(self, start: str) -> dict[str, set[str]]:
        """The symbols after each rule ("$" is the end); rules inside others must not be empty."""
        first: dict[str, set[str]] = {r: set() for r in self.rules}
        follow: dict[str, set[str]] = {r: set() for r in self.rules}
        follow[start].add("$")
        for _ in range(len(self.grammar) ** 2):
            for left, right in self.grammar:
                for j, x in enumerate(right):
                    after = right[j + 1 : j + 2]
                    if j == 0:
                        first[left] |= first.get(x, {x})
                    if x in self.rules:
                        follow[x] |= first.get(after, {after}) if after else follow[left]
        return follow


class Stacks:
    """The nodes of the graph-structured stack: (LR state, node below), each made once; 0 is the bottom."""

    def __init__(self, tables: Tables):
        self.tables, self.nodes, self.number = tables, [(0, -1)], {(0, -1): 0}

    def _push(self, state: int, below: int) -> int:
        if (state, below) not in self.number:
            self.number[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.number[state, below]

    @functools.cache
    def read(self, node: int, symbol: str) -> int | None:
        """The top after all reductions that ``symbol`` asks for and its shift; at the end ("$") 0 for an accepted stack."""
        t = self.tables
        state, _ = self.nodes[node]
        if (state, symbol) in t.goto:
            return self._push(t.goto[state, symbol], node)
        for k, dot in sorted(t.states[state]):
            left, right = t.grammar[k]
            if dot == len(right) and symbol in t.follow[left]:
                below = node
                for _ in right:
                    below = self.nodes[below][1]
                if left == t.grammar[0][0]:
                    return 0
                return self.read(self._push(t.goto[self.nodes[below][0], left], below), symbol)
        return None

    @functools.cache
    def inserted(self, node: int) -> tuple[tuple[str, int], ...]:
        """The tops that insertions lead to, each by the fewest (the letters inserted, the top)."""
        found, queue = {node: ""}, [node]
        for at in queue:
            for letter in ROLES:
                to = self.read(at, letter)
                if to is not None and to not in found and len(found[at]) < 2:
                    found[to] = found[at] + letter
                    queue.append(to)
        return tuple((letters, to) for to, letters in found.items())


@functools.cache
def _stacks() -> Stacks:
    return Stacks(Tables())


def fault(role: str, text: str, again: bool) -> str | None:
    """blank, duplicate, truncated or None; ``again``: an earlier row has this role and text."""
    seen = _VISIBLE.search(text)
    if not seen:
        return "blank"
    if again:
        return "duplicate"
    return None if text.rstrip(" \t\n\v\f\r")[-1] in _ENDS else "truncated"


class Repair:
    """One conversation's rows, read one after the other."""

    WIDTH = 32  # bytes a row: one for each node of the stack
    EDITS = [i + e for i in ("", "I", "II") for e in "DKR"]

    def __init__(self):
        self.stacks = _stacks()
        #: top: (cost, place among all tops by audit, running hash, whether it holds a turn)
        self.tops = {0: (0, 0, hashlib.sha256(), False)}
        self.back = bytearray()

    def row(self, role: str, text: str, wrong: str | None) -> None:
        best: dict[int, tuple] = {}
        stays, late, letter = wrong not in ("blank", "duplicate"), TRUNCATED * (wrong == "truncated"), role[:1]
        for top, (cost, place, _, _) in self.tops.items():
            for extra, at in self.stacks.inserted(top):
                c, i = cost + INSERT * len(extra), "I" * len(extra)
                ways = [(c + DELETE, place, i + "D", "", at)]
                if stays:
                    ways += [(c + KEEP + late, place, i + "K", role, self.stacks.read(at, letter) if letter else None)]
                    ways += [(c + REROLE + late, place, i + "R", ROLES[x], self.stacks.read(at, x)) for x in ROLES]
                for *key, new_role, to in ways:
                    if to is not None and (to not in best or key < best[to][0]):
                        best[to] = (key, top, extra, new_role)
        line, tops = bytearray(self.WIDTH), {}
        order = sorted(best, key=lambda to: best[to][0][1:])
        for place, to in enumerate(order):
            (cost, _, letters), top, extra, new_role = best[to]
            *_, sha, begun = self.tops[top]
            turns = [f"{ROLES[x]}:" for x in extra] + ([f"{new_role}:{text}"] if letters[-1] != "D" else [])
            if turns:
                sha = sha.copy()
                sha.update(("\n" * begun + "\n".join(turns)).encode("utf-8", "surrogatepass"))
            line[to] = top << 4 | self.EDITS.index(letters)
            tops[to] = (cost, place, sha, begun or bool(turns))
        self.tops = tops
        self.back += line

    def result(self) -> tuple[int, str, str]:
        """The least cost, its audit and the hash of the repaired turns."""
        ends = [(cost + INSERT * len(extra), place, extra, top) for top, (cost, place, _, _) in self.tops.items() for extra, at in self.stacks.inserted(top) if self.stacks.read(at, "$") is not None]
        cost, _, extra, top = min(ends)
        *_, sha, begun = self.tops[top]
        if extra:
            sha = sha.copy()
            sha.update(("\n" * begun + "\n".join(f"{ROLES[x]}:" for x in extra)).encode())
        audit = [("I" * len(extra))]
        for k in range(len(self.back) - self.WIDTH, -1, -self.WIDTH):
            code = self.back[k + top]
            audit.append(self.EDITS[code & 15])
            top = code >> 4
        return cost, "".join(reversed(audit)), sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays as a row with ``lost``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), _ENDS, "")).otherwise(one("text"))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), kind.alias("kind"))
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, and ``lost`` for rows that are no more): faults and cheapest repair."""
    own = rows.select("conv_id", "turn", "role", "text", "lost").repartition("conv_id")
    seen = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    flagged = own.withColumn("again", F.row_number().over(seen) > 1)
    inside = flagged.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "lost", F.col("turn").asc_nulls_first(), "role", "text", "again")
    kind = rows.schema["conv_id"].dataType.simpleString()
    bounded_batches(rows.sparkSession)

    def run(batches):
        conv, at, out, arrow = None, None, [], None
        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for c, turn, role, text, lost, again in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if at is None or c != conv:
                    if at is not None:
                        out.append((conv, *at.figures()))
                    conv, at = c, _Conversation()
                if not lost:
                    at.add(turn, role, text, again)
            if len(out) >= 500:
                yield _batch(out, arrow)
                out = []
        if at is not None:
            yield _batch([*out, (conv, *at.figures())], arrow)

    return inside.mapInArrow(lean(run), f"conv_id {kind}, {_OUT}")


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [("conv_id", key), *((f, pa.int64()) for f in _FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class _Conversation:
    """Counts of faults of one conversation beside its repair; rows come in order."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self):
        self.repair, self.count = Repair(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn, role: str, text: str, again: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None and self.before + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.before = role[:1]
        wrong = fault(role, text, again)
        if wrong:
            self.count[wrong] += 1
        self.repair.row(role, text, wrong)

    def figures(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.count.values(), self.illegal, *self.repair.result())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The digest by a search over (rows read, state of the grammar) with whole audit strings; for small inputs."""
    by_conv: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        by_conv.setdefault(conv, []).extend([(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    step = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            shown = text.strip(" \t\n\v\f\r")
            f = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(f)
            if f:
                n[f] += 1
        least = {"0": (0, "", ())}

        def insertions(found):
            for _ in range(4):
                for s, (c, a, t) in list(found.items()):
                    for x, role in ROLES.items():
                        to, way = step.get((s, x)), (c + 5, a + "I", (*t, f"{role}:"))
                        if to and (to not in found or way[:2] < found[to][:2]):
                            found[to] = way
            return found

        for (_, _, role, text), f in zip(own, faults):
            new: dict = {}
            for s, (c, a, t) in insertions(least).items():
                ways = [(s, c + 2, a + "D", t)]
                if f not in ("blank", "duplicate"):
                    late = 5 * (f == "truncated")
                    ways += [(step.get((s, role[:1])), c + late, a + "K", (*t, f"{role}:{text}"))]
                    ways += [(step.get((s, x)), c + 1 + late, a + "R", (*t, f"{r}:{text}")) for x, r in ROLES.items()]
                for to, *way in ways:
                    if to and (to not in new or way[:2] < list(new[to][:2])):
                        new[to] = tuple(way)
            least = new
        cost, audit, turns = min(v for s, v in insertions(least).items() if s in "0A")
        told = [r[1] for r in own if r[0]]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return out


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(8) AS BIGINT[])),
  lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 20 AS kind FROM keyed),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) u(copy)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown, left(role, 1) AS x FROM g),
f AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(shown, '[.!?]$') THEN 'truncated' END AS fault,
  lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
steps AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late, coalesce(fault IN ('blank', 'duplicate'), false) AS goes FROM f),
-- The least (cost, audit) in each state of the grammar: nothing yet, after s, after u, after a; with what insertions add.
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, [0, 1000000000, 1000000000, 1000000000] AS c, ['', '', '', ''] AS a FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, i, list_transform(best, lambda b: b[1].c), list_transform(best, lambda b: b[1].a) FROM (
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda t: list_sort(list_transform(list_filter(ways, lambda w: w.t = t), lambda w: {'c': w.c, 'a': w.a}) || [{'c': 1000000000, 'a': ''}])) AS best
  FROM (SELECT conv_id, i, flatten(list_transform(ins, lambda s: [{'t': s.t, 'c': s.c + 2, 'a': s.a || 'D'}]
    || CASE WHEN goes THEN [] ELSE list_filter([
      {'t': CASE WHEN s.t = 1 AND x = 's' THEN 2 WHEN s.t <> 3 AND x = 'u' THEN 3 WHEN s.t = 3 AND x = 'a' THEN 4 ELSE 0 END, 'c': s.c + late, 'a': s.a || 'K'},
      {'t': CASE WHEN s.t = 3 THEN 4 ELSE 3 END, 'c': s.c + 1 + late, 'a': s.a || 'R'}], lambda w: w.t > 0) END)) AS ways
  FROM (SELECT w.conv_id, s.i, s.goes, s.late, s.x, flatten(list_transform([1, 2, 3, 4], lambda t: CASE WHEN w.c[t] >= 1000000000 THEN [] WHEN t = 3
      THEN [{'t': 3, 'c': w.c[3], 'a': w.a[3]}, {'t': 4, 'c': w.c[3] + 5, 'a': w.a[3] || 'I'}]
      ELSE [{'t': t, 'c': w.c[t], 'a': w.a[t]}, {'t': 3, 'c': w.c[t] + 5, 'a': w.a[t] || 'I'}, {'t': 4, 'c': w.c[t] + 10, 'a': w.a[t] || 'II'}] END)) AS ins
    FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)))),
ends AS (SELECT conv_id, list_sort([{'c': c[1], 'a': a[1]}, {'c': c[2] + 10, 'a': a[2] || 'II'}, {'c': c[3] + 5, 'a': a[3] || 'I'}, {'c': c[4], 'a': a[4]}])[1] AS e
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
letters AS (SELECT conv_id, e.a AS audit, k, substr(e.a, CAST(k AS BIGINT), 1) AS edit FROM ends, unnest(range(1, len(e.a) + 1)) u(k)),
placed AS (SELECT conv_id, k, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS p FROM letters),
turns AS (SELECT p.*, s.role, coalesce(s.text, '') AS text, max(CASE WHEN p = 1 AND edit = 'K' AND s.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS head
  FROM placed p LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i AND p.edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t FROM turns GROUP BY conv_id),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal,
  CAST(e.e.c AS BIGINT) AS cost, e.e.a AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
FROM ends e LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
