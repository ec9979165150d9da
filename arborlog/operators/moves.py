"""Moves inside delete-and-create plans, and renames by similarity of bodies: greedy choices, made for each plan or container apart."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR, MARGIN = 0.60, 0.20
PLAN = "plan_id string, seq long, op_type string, symbol_id string, parent_id string, kind string, name string, body string, metadata string, reference_id string, from_symbol_id string, to_symbol_id string"
_FIELDS = [x.split()[0] for x in PLAN.split(", ")]


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that two tables of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def collapse_moves(ops: list[dict], base: dict[str, dict]) -> list[dict]:
    """One plan's operations with relocated subtrees as moves. base: symbols by id.

    A deleted subtree whose parent stays, and a created one of the same shape, kinds and names under another parent, become one move
    of the root; the created ids become the old ones everywhere; edits of bodies and metadata follow at the end.
    """
    deleted = {o["symbol_id"] for o in ops if o["op_type"] == "DeleteSymbol" and o["symbol_id"] in base}
    created = {o["symbol_id"]: o for o in ops if o["op_type"] == "CreateSymbol"}
    old_kids, new_kids = defaultdict(list), defaultdict(list)
    for i, s in base.items():
        old_kids[s["parent_id"]].append(i)
    for i, o in created.items():
        new_kids[o["parent_id"]].append(i)
    key = lambda s: (s["kind"], s["name"])

    def paired(old: str, new: str) -> dict[str, str] | None:
        """Old to new ids of two subtrees of one shape. Iterative, as trees may be deep."""
        out, todo = {}, [(old, new)]
        while todo:
            a, b = todo.pop()
            if key(base[a]) != key(created[b]) or len(old_kids[a]) != len(new_kids[b]):
                return None
            by_key = {key(created[x]): x for x in new_kids[b]}
            if len(by_key) != len(new_kids[b]) or any(key(base[x]) not in by_key for x in old_kids[a]):
                return None
            out[a] = b
            todo += [(x, by_key[key(base[x])]) for x in old_kids[a]]
        return out

    by_key = defaultdict(list)
    for i in sorted(created):
        by_key[key(created[i])].append(i)
    new_to_old, moved, edits, used = {}, {}, [], set()
    for root in sorted(i for i in deleted if base[i]["parent_id"] not in deleted):
        if root in used:
            continue
        for i in by_key[key(base[root])]:
            if i in new_to_old or created[i]["parent_id"] == base[root]["parent_id"]:
                continue
            pairs = paired(root, i)
            if pairs is None or not deleted.issuperset(pairs):
                continue
            moved[i] = root
            for a in sorted(pairs):
                new = created[pairs[a]]
                used.add(a)
                new_to_old[pairs[a]] = a
                body = new["body"] if new["body"] != base[a]["body"] else None
                metadata = new["metadata"] if new["metadata"] != base[a]["metadata"] else None
                if body is not None or metadata is not None:
                    edits.append({"op_type": "UpdateSymbol", "symbol_id": a, "body": body, "metadata": metadata})
            break
    if not moved:
        return ops
    out = []
    for o in ops:
        i = o["symbol_id"]
        if o["op_type"] == "DeleteSymbol" and i in used or o["op_type"] == "CreateSymbol" and i in new_to_old and i not in moved:
            continue
        if o["op_type"] == "CreateSymbol" and i in moved:
            out.append({"op_type": "MoveSymbol", "symbol_id": moved[i], "parent_id": o["parent_id"]})
            continue
        out.append(o | {k: new_to_old.get(o.get(k), o.get(k)) for k in ("symbol_id", "parent_id", "from_symbol_id", "to_symbol_id")})
    return out + edits


def detect_moves(plans: DataFrame, base: DataFrame) -> DataFrame:
    """plans (PLAN columns, several plans) and base(plan_id, symbol_id, parent_id, kind, name, body, metadata) -> plans with moves.

    A plan is small beside a corpus, and its choices depend on each other, so each is worked on whole by one task.
    """

    def run(key, ops, symbols):
        rows = ops.sort_values("seq").astype(object).where(ops.sort_values("seq").notna(), None).to_dict("records")
        known = {s["symbol_id"]: s for s in symbols.astype(object).where(symbols.notna(), None).to_dict("records")}
        out = collapse_moves(rows, known)
        return pd.DataFrame([{c: o.get(c) for c in _FIELDS} | {"plan_id": key[0], "seq": i + 1} for i, o in enumerate(out)], columns=_FIELDS)

    return _apart(plans).groupBy("plan_id").cogroup(_apart(base).groupBy("plan_id")).applyInPandas(run, PLAN)


def token_set(body: str | None) -> frozenset[str]:
    return frozenset(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.split(r"[^\w]+", body or "") if t)


def body_similarity(a: str | None, b: str | None) -> float:
    x, y = token_set(a), token_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


class AmbiguousIdentity(ValueError):
    """Several symbols are left on both sides and none is clearly the same."""


def _best_two(left: dict[int, dict], new: dict[int, dict]) -> list[tuple[float, int, int]]:
    """The two highest (similarity, base, edited) among pairs of one kind, as far as they bear on the choice.

    Scores under NEAR - MARGIN can neither be taken nor stand in the way of one that can, so two bodies only meet if they share one
    of their rarer tokens (all but the most frequent ones that such a score allows them to differ in). Equal bodies meet by
    hash, and the search ends once the second is so high that no first could be ahead of it.
    """
    old, fresh = defaultdict(list), defaultdict(list)
    for sets, rows in ((old, left), (fresh, new)):
        for i, s in rows.items():
            sets[s["kind"], token_set(s.get("body"))].append(i)
    top: list[tuple[float, int, int]] = []

    def settled(score: float, a: list[int], b: list[int]) -> bool:
        top.extend([(score, i, j) for i in a[:2] for j in b[:2]])
        top.sort(key=lambda x: (-x[0], *x[1:]))
        del top[2:]
        return len(top) > 1 and 1.0 - top[1][0] < MARGIN

    for k in fresh:
        if k in old and settled(1.0, old[k], fresh[k]):
            return top
    seen = Counter(t for _, tokens in [*old, *fresh] for t in tokens)
    least = NEAR - MARGIN - 1e-9

    def rarest(tokens: frozenset[str]) -> list[str]:
        return sorted(tokens, key=lambda t: (seen[t], t))[: len(tokens) - math.ceil(least * len(tokens)) + 1]

    holders = defaultdict(list)
    for k in old:
        for t in rarest(k[1]):
            holders[k[0], t].append(k)
    for k in fresh:
        for o in {o for t in rarest(k[1]) for o in holders[k[0], t]}:
            shared = len(o[1] & k[1])
            if o[1] != k[1] and settled(shared / (len(o[1]) + len(k[1]) - shared), old[o], fresh[k]):
                return top
    return top


def match_symbols(base: list[dict], edited: list[dict], greedy: bool = True) -> list[tuple[int, int]]:
    """Pairs (base, edited) of one container: by id and kind, by kind and name, then by similarity of bodies.

    One left on each side: the same if near enough. Else, if greedy, the best pair is taken while it is near enough and ahead
    of the next (at most three times, as each is behind the last by MARGIN); what is then left on both sides is refused.
    """
    pairs: list[tuple[int, int]] = []
    left, new = dict(enumerate(base)), dict(enumerate(edited))

    def take(i: int, j: int) -> None:
        pairs.append((i, j))
        del left[i], new[j]

    for keys in (("symbol_id", "kind"), ("kind", "name")):
        known = defaultdict(deque)
        for i, s in left.items():
            known[tuple(s.get(k) for k in keys)].append(i)
        for j in list(new):
            if keys[0] == "symbol_id" and new[j].get("symbol_id") is None:
                continue
            if same := known.get(tuple(new[j].get(k) for k in keys)):
                take(same.popleft(), j)

    if len(left) == len(new) == 1:
        (i, s), (j, e) = *left.items(), *new.items()
        if s["kind"] == e["kind"] and body_similarity(s.get("body"), e.get("body")) >= NEAR:
            take(i, j)
        elif not greedy:
            raise AmbiguousIdentity("refusing to guess between one symbol and another")
        return sorted(pairs)
    while greedy and left and new:
        best = _best_two(left, new)
        if not best or best[0][0] < NEAR or best[0][0] - (best[1][0] if len(best) > 1 else 0.0) < MARGIN:
            break
        take(best[0][1], best[0][2])
    if left and new:
        raise AmbiguousIdentity(f"refusing to guess between existing {[s['name'] for s in left.values()]} and edited {[e['name'] for e in new.values()]}")
    return sorted(pairs)


MATCHES = "container string, base_name string, edited_name string, outcome string"


def detect_renames(base: DataFrame, edited: DataFrame, greedy: bool = True) -> DataFrame:
    """base and edited (container, symbol_id, kind, name, body, seq) -> (container, base_name, edited_name, outcome).

    outcome: kept, renamed, added, deleted, or ambiguous for each symbol of a container that is refused.
    """

    def run(key, a, b):
        a, b = ([{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in x.sort_values("seq").to_dict("records")] for x in (a, b))
        try:
            pairs = match_symbols(a, b, greedy)
        except AmbiguousIdentity:
            rows = [(s["name"], None, "ambiguous") for s in a] + [(None, e["name"], "ambiguous") for e in b]
        else:
            rows = [(a[i]["name"], b[j]["name"], "kept" if a[i]["name"] == b[j]["name"] else "renamed") for i, j in pairs]
            old, new = {i for i, _ in pairs}, {j for _, j in pairs}
            rows += [(s["name"], None, "deleted") for i, s in enumerate(a) if i not in old] + [(None, e["name"], "added") for j, e in enumerate(b) if j not in new]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["container", "base_name", "edited_name", "outcome"])

    return _apart(base).groupBy("container").cogroup(_apart(edited).groupBy("container")).applyInPandas(run, MATCHES)
