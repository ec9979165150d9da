"""A plain sequential replay, as the reference for tests."""


def fold(ops):
    """ops: dicts in order -> (first failing ordinal or None, symbols by id, references by id)."""
    sym, ref = {}, {}

    def clash(parent, kind, name, but=None):
        return any(s["parent_id"] == parent and s["kind"] == kind and s["name"] == name for i, s in sym.items() if i != but)

    for o in ops:
        t, i = o["op_type"], o.get("symbol_id")
        bad = False
        if t == "CreateSymbol":
            bad = i in sym or (o["parent_id"] is not None and o["parent_id"] not in sym) or clash(o["parent_id"], o["kind"], o["name"])
            if not bad:
                sym[i] = {k: o.get(k) for k in ("parent_id", "kind", "name", "body", "metadata", "ordinal")}
        elif t == "DeleteSymbol":
            bad = i not in sym or any(s["parent_id"] == i for s in sym.values()) or any(i in (r["from_symbol_id"], r["to_symbol_id"]) for r in ref.values())
            if not bad:
                del sym[i]
        elif t == "UpdateSymbol":
            bad = i not in sym or (o.get("name") is not None and clash(sym[i]["parent_id"], sym[i]["kind"], o["name"], i))
            if not bad:
                sym[i] |= {k: o[k] for k in ("name", "body", "metadata") if o.get(k) is not None}
        elif t == "MoveSymbol":
            p = o["parent_id"]
            bad = i not in sym or p == i or (p is not None and p not in sym)
            at = p
            while not bad and at is not None:
                bad = at == i
                at = sym[at]["parent_id"]
            bad = bad or clash(p, sym[i]["kind"], sym[i]["name"], i)
            if not bad:
                sym[i]["parent_id"] = p
        elif t == "CreateReference":
            bad = o["reference_id"] in ref or o["from_symbol_id"] not in sym or o["to_symbol_id"] not in sym
            if not bad:
                ref[o["reference_id"]] = {k: o.get(k) for k in ("from_symbol_id", "to_symbol_id", "kind", "ordinal")}
        elif t == "DeleteReference":
            bad = o["reference_id"] not in ref
            if not bad:
                del ref[o["reference_id"]]
        if bad:
            return o["ordinal"], sym, ref
    return None, sym, ref
