"""Matching people across sources without keys: collective graph linkage.

* Rows are reduced to profiles (distinct combinations of what they say), so copies of a row cost nothing.
* Candidate edges join profiles of one block: a phone line, a mailbox, or the firm's first letters with the given name's initial. Within
  a block a pigeonhole segment join over its distinct surnames finds those that may be one, however many profiles the block
  holds; distinct names are compared once per block. An attribute weighs the more, the rarer it is.
* Meta-blocking prunes edges whose shared attributes and likeness of names weigh too little.
* The remaining graph is refined until it is stable: profiles with only an initial, or without a name, take the name that their
  neighbours support most, hop by hop; edges that are too weak of themselves count once a neighbour over another edge bears the very name of the
  other end; edges of vague profiles are scored again by the names told. An edge survives if its two profiles then bear one name.

All thresholds are shares or likenesses; none is a count that the same rows would pass in a small table and fail in a large one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.llm import names as N
from rollweave.functions.segments import cuts as segments
from rollweave.functions.segments import probes
from rollweave.session import cut, store

#: Edits between two surnames that the segment join finds on a line or mailbox, and where a firm alone is shared. A swap of neighbours
#: counts as two here and as one when names are scored, so these are one above what scoring accepts.
LINE_EDITS, FIRM_EDITS = 4, 3
#: How often a surname that is a slip of another may come again, as a share of how often the other does.
SLIP_SHARE = 0.1
#: Share of all mailboxes that a host must have to be cut off an address without ``@``; there are at most 200 such hosts.
COMMON_HOST = 0.005
#: Share of all names that a word must open to count as a common given name; there are at most 500 such words.
COMMON_GIVEN = 0.002

PROFILE = "given string, surname string, short string, phone string, local string, host string, firm array<string>, acronym string"
ATTRIBUTES = ("given", "surname", "short", "phone", "local", "host", "firm", "acronym")


def common_hosts(mails: DataFrame) -> list[str]:
    """Hosts of at least ``COMMON_HOST`` of the addresses in the only column of ``mails``, longest first."""
    host = F.regexp_extract(F.lower(F.trim(F.col(mails.columns[0]))), r"@\s*([a-z0-9-]+\.[a-z.]+)$", 1)
    counts = mails.select(host.alias("h")).filter("h != ''").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted((r["h"] for r in counts.filter(F.col("n") >= COMMON_HOST * total).collect()), key=lambda h: (-len(h), h))


def common_givens(typed: DataFrame) -> list[str]:
    """Words that open at least ``COMMON_GIVEN`` of the names in the only column of ``typed`` and close far fewer, in plain letters, and their beginnings."""
    c = F.col(typed.columns[0])
    ends = typed.select(F.explode(F.array(F.struct(F.regexp_extract(c, r"^([\p{L}\p{M}]{2,})\s", 1).alias("w"), F.lit(1).alias("first")), F.struct(F.regexp_extract(c, r"[^,]\s([\p{L}\p{M}]{2,})$", 1).alias("w"), F.lit(0).alias("first")))).alias("e"))
    words = ends.select("e.*").filter("w != ''").groupBy(F.initcap("w").alias("w")).agg(F.sum("first").alias("a"), F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("a")).first()[0] or 0
    often = words.filter((F.col("a") >= F.greatest(F.lit(3), F.lit(COMMON_GIVEN * total))) & (F.col("a") > 0.6 * F.col("n")))
    full = {N.plain(r["w"]) for r in often.collect()}
    return sorted(full | {g[:n] for g in full for n in range(2, len(g))})


def profile(name: Column, mail: Column, phone: Column, firm: Column, hosts: list[str], givens: list[str]) -> Column:
    """What a row says about a person, as a struct of ``PROFILE``; parts that can't be read are null."""
    known = frozenset(givens)

    @F.pandas_udf(PROFILE)
    def read(name: pd.Series, mail: pd.Series, phone: pd.Series, firm: pd.Series) -> pd.DataFrame:
        out = []
        for n, m, p, f in zip(name.to_numpy(), mail.to_numpy(), phone.to_numpy(), firm.to_numpy(), strict=True):
            person, box, line, company = N.parse_name(n, known), N.mail_parts(m), N.phone_key(p), N.parse_firm(f)
            if box and not box[1]:
                end = next((h for h in hosts if box[0].endswith(h) and len(box[0]) > len(h)), None)
                box = (box[0][: -len(end)], end) if end else box
            out.append((*(person or (None, None, None)), line, *(box or (None, None)), list(company.words) if company else None, company.acronym if company else None))
        return pd.DataFrame(out, columns=list(ATTRIBUTES))

    return read(name, mail, phone, firm)


def profiles(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``side``, ``row`` and the struct ``p``) with ``node``, a number equal for rows of a side that say the same."""
    return rows.select("side", "row", F.xxhash64("side", *[F.col(f"p.{a}") for a in ATTRIBUTES]).alias("node"), "p")


def _firm_codes(words: list[str] | None, acronym: str | None) -> set[str]:
    """First letters of the root and of the word after it; those that an acronym may stand for."""
    if acronym:
        return {acronym[0] + acronym[1:2], acronym[0] + acronym[2:3]}
    if words is None or not len(words):
        return set()
    return {words[0][0] + (words[1][0] if len(words) > 1 else "")}


def _initials(given: str, short: str | None) -> set[str]:
    full = {given, *N.full_names(given)} | ({short, *N.full_names(short)} if short else set())
    return {g[0] for g in full if g}


def blocks(nodes: DataFrame, across: bool) -> DataFrame:
    """``kind`` (one of ``KINDS``), ``block``, ``part``, ``node``, ``side`` and what tells the name of each node in each of its blocks.

    A block is a phone line, a mailbox, or firm letters with an initial (a node with several initials is in several); those of the
    last kind hold named nodes only, and their ``part`` is one first letter of the surname. ``twin`` is the host of a mailbox, ``words`` and
    ``acronym`` are the firm in the last kind. Made in one pass, so that the nodes are shuffled once.
    """

    @F.pandas_udf("array<string>")
    def codes(given: pd.Series, short: pd.Series, firm: pd.Series, acronym: pd.Series) -> pd.Series:
        return pd.Series([sorted(f"{c}/{i}" for c in _firm_codes(None if f is None else f.split(" "), a) for i in _initials(g, s)) if g else [] for g, s, f, a in zip(given, short, firm, acronym, strict=True)])

    named = F.col("surname").isNotNull() & (F.col("firm").isNotNull() | F.col("acronym").isNotNull())
    coded = nodes.withColumn("codes", codes("given", "short", "firm", "acronym"))
    null = F.lit(None).cast("string")
    one = lambda kind, key, twin, words, acronym, part: F.struct(F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"), F.xxhash64(F.lit(kind), key).alias("block"), F.xxhash64(F.lit(kind), key, part).alias("part"), twin.alias("twin"), words.alias("words"), acronym.alias("acronym"), key.alias("key"))
    lines = F.array(one("phone", F.col("phone"), null, null, null, F.lit("")), one("mail", F.col("local"), null if across else F.col("host"), null, null, F.lit("")))
    firms = F.when(named, F.transform("codes", lambda c: one("name", c, null, F.col("firm"), F.col("acronym"), F.substring("surname", 1, 1))))
    every = F.concat(F.filter(lines, lambda x: x["key"].isNotNull()), F.coalesce(firms, F.array().cast(f"array<{dict(coded.select(lines.alias('x')).dtypes)['x'][6:-1]}>")))
    return coded.select("node", "side", "given", "surname", "short", F.explode(every).alias("k")).select("k.kind", "k.block", "k.part", "node", "side", "given", "surname", "short", "k.twin", "k.words", "k.acronym")


def alike_surnames(surnames: list[str], k: int) -> Iterator[tuple[str, str]]:
    """Pairs of different ``surnames`` that may be within ``k`` edits, each pair once.

    This is the pigeonhole segment join: the ``k + 1`` segments of a surname are looked up, in an inverted index, among the shifted
    substrings of the longer ones (of two equally long ones both look); what meets is verified by its letters here and by
    edit distances where it is scored.
    """
    index: dict[tuple[int, int, str], list[int]] = {}
    lengths = set()
    for at, s in enumerate(surnames):
        lengths.add(len(s))
        for i, (p, n) in enumerate(segments(len(s), k)):
            index.setdefault((len(s), i, s[p : p + n]), []).append(at)
    letters = [_letters(s) for s in surnames]
    for y, s in enumerate(surnames):
        met: set[int] = set()
        for other, i, p, n in probes(len(s), k):
            if other in lengths and (hit := index.get((other, i, s[p : p + n]))):
                met.update(hit)
        for x in met:
            # of two equally long ones the pair is met from either side
            if (len(surnames[x]) < len(s) or x < y) and (letters[x] ^ letters[y]).bit_count() <= 2 * k:
                yield surnames[x], s


@lru_cache(maxsize=N.CACHE)
def _letters(text: str) -> int:
    """A bit for each letter of a text; an edit changes at most two of them."""
    out = 0
    for c in text:
        out |= 1 << (ord(c) & 63)
    return out


def _plain_edits(a: str, b: str, most: int) -> bool:
    """Whether two texts are within ``most`` edits of which a swap counts as two."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[j - 1] + 1))
        if min(row) > most:
            return False
        prev = row
    return prev[-1] <= most


class _Edges:
    """Rows of ``EDGES`` that are gathered until they fill a batch."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, u: np.ndarray, v: np.ndarray, kind: int, n: int, name_l: float, loose: float) -> None:
        self.parts.append((u, v, kind, n, name_l, loose))
        self.rows += len(u)

    def batch(self) -> pa.RecordBatch:
        long = [len(p[0]) for p in self.parts]
        column = lambda i, kind: np.repeat(np.array([p[i] for p in self.parts], kind), long)
        name_l = column(4, "float64")
        cols = [pa.array(np.concatenate([p[0] for p in self.parts])), pa.array(np.concatenate([p[1] for p in self.parts])), pa.array(column(2, "int8")), pa.array(column(3, "int64")), pa.array(name_l, mask=np.isnan(name_l)), pa.array(column(5, "float64"), mask=np.isnan(name_l))]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays(cols, ["u", "v", "kind", "n", "name_l", "loose"])


#: Kinds of blocks; in ``name`` blocks the firm must fit too.
KINDS = ("phone", "mail", "name")
EDGES = "u bigint, v bigint, kind tinyint, n bigint, name_l double, loose double"
#: Edges that a task sends on at once.
BATCH = 20_000


def _cross(a: list[int], b: list[int], sort: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two lists of nodes, some at a time; with ``sort`` the lesser one first."""
    right = np.array(b, "int64")
    step = max(1, BATCH // max(1, len(b)))
    for at in range(0, len(a) if len(b) else 0, step):
        left = np.array(a[at : at + step], "int64")
        u, v = np.repeat(left, len(right)), np.tile(right, len(left))
        yield (np.minimum(u, v), np.maximum(u, v)) if sort else (u, v)


def _block_edges(kind: int, rows: dict[str, list], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, float, float]]:
    """The candidate edges of one part of a block."""
    n, by_firm = len(rows["node"]), KINDS[kind] == "name"
    nodes, sides = rows["node"], rows["side"]
    # surname -> (given, short) -> firm -> places of its rows
    lines: dict[str, dict[tuple[str, str], dict[tuple, list[int]]]] = {}
    bare = []
    for at, (s, g, h, w, a) in enumerate(zip(rows["surname"], rows["given"], rows["short"], rows["words"], rows["acronym"], strict=True)):
        if s is None:
            bare.append(at)
        else:
            lines.setdefault(s, {}).setdefault((g, h or ""), {}).setdefault((w, a), []).append(at)
    on = lambda ats, side: [nodes[i] for i in ats if sides[i] == side]
    fits: dict[tuple, bool] = {}

    def fit(f: tuple, g: tuple) -> bool:
        if not by_firm or f == g:
            return True
        if (f, g) not in fits:
            fits[f, g] = N.firm_likeness(_firm(*f), _firm(*g)) > 0
        return fits[f, g]

    def join(x: dict, y: dict, same: bool, name_l: float, loose: float) -> Iterator[tuple]:
        for f, p in x.items():
            for g, q in y.items():
                if fit(f, g):
                    if across:
                        for u, v in _cross(on(p, 0), on(q, 1), False):
                            yield u, v, kind, n, name_l, loose
                        if not same:
                            for u, v in _cross(on(q, 0), on(p, 1), False):
                                yield u, v, kind, n, name_l, loose
                    else:
                        for u, v in _cross([nodes[i] for i in p], [nodes[i] for i in q], True):
                            yield u, v, kind, n, name_l, loose

    def score(sa: str, fa: tuple, sb: str, fb: tuple) -> tuple[float, float] | None:
        name_l, loose = _name_score(fa[0], sa, fa[1], fb[0], sb, fb[1])
        return (name_l, loose) if name_l > 0 or loose > 0 and not by_firm else None

    for s, faces in lines.items():
        of = list(faces.items())
        for i, (fa, x) in enumerate(of):
            if across:
                yield from join(x, x, True, *_name_score(fa[0], s, fa[1], fa[0], s, fa[1]))
            else:
                yield from _twins(kind, n, fa[0], x, rows, fit)
            for fb, y in of[i + 1 :]:
                if found := score(s, fa, s, fb):
                    yield from join(x, y, False, *found)
    heads: dict[str, list[str]] = {}
    for s in lines:
        heads.setdefault(s[0], []).append(s)
    most = FIRM_EDITS if by_firm else LINE_EDITS
    for surnames in heads.values():
        for a, b in alike_surnames(surnames, most) if len(surnames) > 1 else ():
            near = N.surname_likeness(a, b) > 0
            if not near and (by_firm or min(len(a), len(b)) <= 5 or N.edits(a, b, 3) > 3) or not _plain_edits(a, b, most):
                continue
            for fa, x in lines[a].items():
                for fb, y in lines[b].items():
                    if found := score(a, fa, b, fb):
                        yield from join(x, y, False, *found)
    if bare:
        nan = float("nan")
        named = [i for i in range(n) if rows["surname"][i] is not None]
        if across:
            for u, v in (*_cross(on(bare, 0), on(range(n), 1), False), *_cross(on(named, 0), on(bare, 1), False)):
                yield u, v, kind, n, nan, nan
        else:
            for u, v in _cross([nodes[i] for i in bare], [nodes[i] for i in named], True):
                yield u, v, kind, n, nan, nan
            empty = sorted(nodes[i] for i in bare)
            for i, x in enumerate(empty[:-1]):
                for u, v in _cross([x], empty[i + 1 :], True):
                    yield u, v, kind, n, nan, nan


def _twins(kind: int, n: int, given: str, face: dict[tuple, list[int]], rows: dict[str, list], fit: Callable[[tuple, tuple], bool]) -> Iterator[tuple]:
    """Pairs of nodes of one name in one block, enough to connect what their pairs would.

    Twins with a full name (of one host, of one firm) are all tied to the least of them, since any two of them are one person by that
    name; of different twins the least ones meet. Initials meet one by one, since neighbours may tell them different names.
    """
    twins: dict[tuple, list[int]] = {}
    for firm, ats in face.items():
        for i in ats:
            twins.setdefault((firm, (rows["twin"][i] or "") if len(given) > 1 else rows["node"][i]), []).append(rows["node"][i])
    least = [(firm, min(nodes)) for (firm, _), nodes in twins.items()]
    for (_, u), nodes in zip(least, twins.values(), strict=True):
        if len(nodes) > 1:
            rest = np.array([x for x in nodes if x != u], "int64")
            yield np.full(len(rest), u), rest, kind, n, 1.0, 0.0
    for i, (f, u) in enumerate(least):
        if others := [v for g, v in least[i + 1 :] if fit(f, g)]:
            for a, b in _cross([u], others, True):
                yield a, b, kind, n, 1.0, 0.0


def candidate_edges(nodes: DataFrame, across: bool) -> DataFrame:
    """``u``, ``v``, the rarity weights ``phone_w`` and ``mail_w`` (null where nothing of the kind is shared), ``name_l`` (null if a name is missing) and ``loose``.

    With ``across``, ``u`` is of side 0 and ``v`` of side 1; otherwise ``u`` < ``v`` of any side. The nodes are shuffled once, by block
    (those that share a firm's letters also by the first letter of the surname), and each block is joined within a task, which holds one part
    at a time: names are compared once for each two distinct ones that the segment join brings together, then spread to the nodes that bear
    them. Where firm letters alone are shared, only nodes whose firms fit meet. Nodes without a name meet all others of their lines and mailboxes.
    """
    total = nodes.count()
    columns = ("surname", "given", "short", "words", "acronym", "twin", "node", "side")

    def useful(t: pa.Table) -> Iterator[tuple[int, dict[str, list]]]:
        """The parts in ``t``, whole and sorted, that can have edges."""
        part = t["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        long = np.diff(np.r_[starts, len(part)])
        good = long > 1
        if across:
            side = t["side"].to_numpy()
            good &= np.minimum.reduceat(side, starts) < np.maximum.reduceat(side, starts)
        t = t.filter(pa.array(np.repeat(good, long)))
        lists = {c: t[c].to_pylist() for c in (*columns, "kind")}
        at = 0
        for m in long[good].tolist():
            yield lists["kind"][at], {c: lists[c][at : at + m] for c in columns}
            at += m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _Edges(), []

        def whole(last: bool) -> Iterator[pa.Table]:
            """What is held, without the last part unless nothing follows."""
            if held and last:
                yield pa.Table.from_batches(held)
                return
            part = held[-1].column("part").to_numpy()
            at = int(np.searchsorted(part, part[-1]))
            if at or len(held) > 1 and held[-2].column("part")[-1].as_py() != part[0]:
                ready = [*held[:-1], held[-1].slice(0, at)]
                held[:] = [held[-1].slice(at)]
                yield pa.Table.from_batches(ready)

        def tables() -> Iterator[pa.Table]:
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    yield from whole(False)
            yield from whole(True) if held else ()

        for t in tables():
            for kind, rows in useful(t):
                for edges in _block_edges(kind, rows, across):
                    if len(edges[0]):
                        out.add(*edges)
                    if out.rows >= BATCH:
                        yield out.batch()
        if out.rows:
            yield out.batch()

    every = blocks(nodes, across).repartition("part").sortWithinPartitions("part").mapInArrow(run, EDGES)
    weight = F.log(F.lit(float(max(2, total))) / F.col("n"))
    return every.groupBy("u", "v").agg(*[F.max(F.when(F.col("kind") == KINDS.index(k), weight)).alias(f"{k}_w") for k in ("phone", "mail")], F.max("name_l").alias("name_l"), F.coalesce(F.max("loose"), F.lit(0.0)).alias("loose"))


def _name(given: str | None, surname: str | None, short: str | None) -> N.Name | None:
    return N.Name(given, surname, short or "") if surname else None


@lru_cache(maxsize=N.CACHE)
def _name_score(ga: str, sa: str, ha: str | None, gb: str, sb: str, hb: str | None) -> tuple[float, float]:
    a, b = N.Name(ga, sa, ha or ""), N.Name(gb, sb, hb or "")
    name, loose = N.name_likeness(a, b), 0.0
    if not name and sa[0] == sb[0] and min(len(sa), len(sb)) > 5 and N.edits(sa, sb, 3) <= 3:
        loose = 1.0 if N.given_likeness(ga, gb) >= 0.85 else 0.0
    if not name and not loose and N.surname_likeness(sa, sb) >= 0.9 and min(len(ga), len(gb)) > 1:
        near = N.edits(ga, gb, 2) <= 2 and max(len(ga), len(gb)) > 3
        loose = float(near or any(N.edits(f[: len(g)], g, 1) <= 1 and f[0] == g[0] and len(g) > 2 for f, g in ((ga, gb), (gb, ga))))
    return name, loose


def _firm(words: str | None, acronym: str | None) -> N.Firm | None:
    return None if words is None and acronym is None else N.Firm(tuple(words.split(" ")) if words else (), acronym or "")


def likeness(pairs: DataFrame) -> DataFrame:
    """Pairs with the structs ``pu`` and ``pv`` gain ``firm_l`` (null if a firm is missing) and ``box``.

    ``box`` tells how far a mailbox names a person, by ``names.box_names``: of two profiles of which one has no name, the mailbox of that
    one and the name of the other; of two with names and one mailbox, both names, the lesser counting, and 0 if the given names differ.
    """

    @F.pandas_udf("firm_l double, box double")
    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        parts = ["given", "surname", "short", "local", "firm", "acronym"]
        for x, y in zip(a[parts].itertuples(index=False), b[parts].itertuples(index=False), strict=True):
            nx, ny, fx, fy = _name(*x[:3]), _name(*y[:3]), _firm(*x[4:]), _firm(*y[4:])
            if nx and ny:
                one = x[3] and x[3] == y[3] and N.given_likeness(nx.given, ny.given) > 0
                box = min(N.box_names(x[3], nx), N.box_names(x[3], ny)) if one else 0.0
            else:
                local = y[3] if nx else x[3]
                box = N.box_names(local, nx or ny) if local and (nx or ny) else 0.0
            out.append((N.firm_likeness(fx, fy) if fx and fy else None, box))
        return pd.DataFrame(out, columns=["firm_l", "box"], dtype="float64")

    return pairs.withColumn("l", score("pu", "pv")).select("*", "l.*").drop("l")


def linked(nodes: DataFrame, across: bool, most_rounds: int = 60) -> DataFrame:
    """Edges between profiles of one person: ``u``, ``v``, ``confidence`` (0 to 1).

    ``nodes`` has one row per profile: ``node``, ``side`` and ``p``. Empty input gives no edges. Profiles without any name, line and
    mailbox have none. The refinement ends when no name and no edge changes any more; ``most_rounds`` without an end are an error.
    """
    flat = nodes.dropDuplicates(["node"]).select("node", "side", *[F.col(f"p.{a}").alias(a) for a in ATTRIBUTES if a != "firm"], F.array_join("p.firm", " ").alias("firm"))
    nodes = store(flat.withColumn("firm", F.nullif("firm", F.lit(""))))
    edges = store(candidate_edges(nodes, across))
    again = nodes.filter("surname IS NOT NULL").groupBy("surname").agg((F.count(F.lit(1)) - 1).alias("again"))
    met = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    withs = store(nodes.join(met.hint("merge"), "node", "left_semi").join(again, "surname", "left").select("node", F.struct(*ATTRIBUTES, "again").alias("p")), nodes)
    side = lambda x: withs.select(F.col("node").alias(x), F.col("p").alias(f"p{x}"))
    # in two steps, so that the shuffle files of the first are gone in the second
    half = store(edges.join(side("u"), "u"), edges)
    scored = likeness(half.join(side("v"), "v"))
    phone = F.coalesce(F.col("pu.phone") == F.col("pv.phone"), F.lit(False))
    hosts = [F.coalesce(F.col(f"{e}.host"), F.lit("")) for e in ("pu", "pv")]
    hosts_fit = (hosts[0] == "") | (hosts[1] == "") | hosts[0].startswith(hosts[1]) | hosts[1].startswith(hosts[0])
    mail = F.coalesce((F.col("pu.local") == F.col("pv.local")) & hosts_fit, F.lit(False))
    firm = F.coalesce(F.col("firm_l") > 0, F.lit(False))
    weight = F.when(phone, F.greatest(F.coalesce("phone_w", F.lit(1.0)), F.lit(1.0))).otherwise(0.0) + F.when(mail, F.greatest(F.coalesce("mail_w", F.lit(1.0)), F.lit(1.0))).otherwise(0.0) + F.when(firm, 2.0 * F.coalesce("firm_l", F.lit(0.0))).otherwise(0.0)
    # meta-blocking: an edge needs a shared attribute besides the names, and names that fit or can still be told
    one_surname = F.col("pu.surname") == F.col("pv.surname")
    # where the firm alone speaks for a pair, one surname must come again far more seldom than the other, or not at all, to be a slip of it
    rarer, commoner = F.least("pu.again", "pv.again"), F.greatest("pu.again", "pv.again")
    slip_ok = phone | mail | one_surname | (rarer <= SLIP_SHARE * commoner)
    likely = F.col("name_l") >= F.when(phone | mail | one_surname, 0.4).otherwise(0.65)
    slips = (F.col("loose") > 0) & (phone | mail) | mail & (F.col("box") >= 0.8)
    # the mailbox of a profile without a name may well name somebody else
    no_name = F.col("pu.surname").isNull() | F.col("pv.surname").isNull()
    elsewhere = no_name & (F.col("box") == 0) & F.when(F.col("pu.surname").isNull(), F.col("pu.local")).otherwise(F.col("pv.local")).isNotNull()
    sure = F.coalesce(likely & slip_ok, F.lit(False)) | slips | (no_name & (phone | mail))
    # what the two say doesn't do, but neighbours may tell that both spellings are of one person
    weak = ~sure & firm & F.coalesce(F.col("name_l") >= 0.4, F.lit(False))
    kept = scored.filter((phone | mail | firm) & (sure | weak)).select(
        "u", "v", weight.alias("weight"), F.coalesce("name_l", F.col("box"), F.lit(0.0)).alias("name_l"), no_name.alias("unnamed"), "box", elsewhere.alias("elsewhere"), phone.alias("phone"), mail.alias("mail"), firm.alias("firm"), weak.alias("weak"),
        F.col("firm_l").alias("firm_l"), F.col("pu.given").alias("gu"), F.col("pv.given").alias("gv"), F.col("pu.surname").alias("su"), F.col("pv.surname").alias("sv"), F.col("pu.short").alias("hu"), F.col("pv.short").alias("hv"),
    )
    kept = store(kept, half, withs)
    told, backed = _refine(kept, most_rounds)
    final = kept.join(backed.withColumn("backed", F.lit(True)), ["u", "v"], "left").filter(~F.col("weak") | F.col("backed"))
    for e in ("u", "v"):
        final = final.join(told.select(F.col("node").alias(e), F.col("name_g").alias(f"tg_{e}"), F.col("name_s").alias(f"ts_{e}")), e, "left")
        final = final.withColumn(f"fg_{e}", F.coalesce(f"tg_{e}", f"g{e}")).withColumn(f"fs_{e}", F.coalesce(f"ts_{e}", f"s{e}"))

    @F.pandas_udf("double")
    def agree(gu: pd.Series, su: pd.Series, gv: pd.Series, sv: pd.Series) -> pd.Series:
        return pd.Series([N.surname_likeness(b, d) * N.given_likeness(a, c) if b and d else 0.0 for a, b, c, d in zip(gu, su, gv, sv, strict=True)], dtype="float64")

    was_vague = _vague("gu", "su") | _vague("gv", "sv")
    final = final.withColumn("now", F.when(was_vague, agree("fg_u", "fs_u", "fg_v", "fs_v")).otherwise(F.col("name_l")))
    # without a name a shared line is enough only if the mailbox or the firm doesn't speak against it
    silent = F.col("unnamed") & ~F.col("mail") & (F.col("box") == 0) & (F.coalesce(F.col("firm_l") == 0, F.lit(False)) | F.col("elsewhere"))
    told_both = F.col("fs_u").isNotNull() & F.col("fs_v").isNotNull()
    fits_now = F.when(F.col("mail") & (F.col("box") >= 0.8) | F.col("unnamed") & (F.col("box") >= 0.9), True).when(told_both, F.col("now") > 0).otherwise((F.col("box") > 0) | F.col("mail") | ~F.col("elsewhere"))
    good = final.filter((~was_vague | fits_now) & ~silent)
    strength = F.col("weight") * F.greatest(F.col("now"), F.lit(0.5))
    return good.select("u", "v", (1 - F.exp(-strength / 3)).alias("confidence"))


def _vague(g: str, s: str) -> Column:
    return F.col(s).isNull() | (F.length(g) == 1)


def _refine(kept: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Names told to profiles without a full one (``node``, ``name_g``, ``name_s``) and the weak edges that neighbours back (``u``, ``v``).

    Names spread hop by hop from the profiles with a full one: in each round the vague profiles next to a told one take the name that
    their told neighbours support most. Every weak edge is scored again in each round: it counts from the round on in which one end has
    a neighbour, over an edge that counts, that bears the very name of the other end. Both only grow, so they come to an end.
    """
    ends = lambda a, b: kept.select(F.col(a).alias("node"), F.col(b).alias("other"), "u", "v", "weak", "weight", "name_l", "box", F.col(f"g{a}").alias("g"), F.col(f"s{a}").alias("s"), F.col(f"g{b}").alias("og"), F.col(f"s{b}").alias("os"))
    links = ends("u", "v").unionByName(ends("v", "u"))
    open_links = cut(links.filter(~F.col("weak") & _vague("g", "s")))
    known = open_links.filter(~_vague("og", "os")).select(F.col("other").alias("node"), F.col("og").alias("name_g"), F.col("os").alias("name_s"), F.lit(1.0).alias("trust")).distinct()
    weak = cut(links.filter("weak").select("node", "other", "u", "v", "og", "os"))
    # names that the neighbours of an end of a weak edge bear
    borne = cut(links.filter(~F.col("weak") & F.col("os").isNotNull()).join(weak.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "og", "os").distinct())
    blank = lambda kind: F.lit(None).cast(kind)
    told = cut(known.limit(0))
    backed, n_backed = cut(weak.select("u", "v").limit(0)), 0
    for hop in range(1, most_rounds + 1):
        # support of each name for each vague profile not told yet: the summed weight of its neighbours that bear it, less with every hop
        votes = open_links.join(told.hint("merge"), "node", "left_anti").join(known.unionByName(told).withColumnRenamed("node", "other").hint("merge"), "other")
        votes = votes.filter(F.col("s").isNull() | (F.levenshtein(F.col("s"), F.col("name_s"), 2) >= 0))
        votes = votes.filter(F.col("g").isNull() | (F.substring("g", 1, 1) == F.substring("name_g", 1, 1)) | (F.col("name_l") > 0))
        by = votes.groupBy("node", "name_g", "name_s").agg(F.sum(F.col("trust") * (F.col("weight") + 6 * F.col("box"))).alias("w"))
        best = by.groupBy("node").agg(F.max_by(F.struct("name_g", "name_s"), F.struct("w", "name_s", "name_g")).alias("b"))
        new = best.select("node", F.col("b.name_g").alias("name_g"), F.col("b.name_s").alias("name_s"), blank("bigint").alias("u"), blank("bigint").alias("v"))
        more = weak.join(backed.hint("merge"), ["u", "v"], "left_semi").select("node", "og", "os")
        held = weak.join(borne.unionByName(more).hint("merge"), ["node", "og", "os"], "left_semi").select("u", "v").distinct()
        both = cut(new.unionByName(held.select(blank("bigint").alias("node"), blank("string").alias("name_g"), blank("string").alias("name_s"), "u", "v")))
        told = told.unionByName(both.filter("node IS NOT NULL").select("node", "name_g", "name_s", F.lit(0.8**hop).alias("trust")))
        backed = both.filter("node IS NULL").select("u", "v")
        before, (n_new, n_backed) = n_backed, both.agg(F.count("node"), F.count("u")).first()
        if n_backed == before and not n_new:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return told.select("node", "name_g", "name_s"), backed
