"""Answers as text for a terminal. The JSON form is the contract; this is for reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

CUT_OFF = "(more rows exist; ask again with a larger --limit)"


def _commit(c: dict | None, subject: bool = True) -> str:
    if not c:
        return "the start of the index"
    return f"{c['oid']} ({c['date']})" + (f" {c['subject']!r}" if subject and c.get("subject") else "")


def _arrow(direction: str) -> str:
    return "->" if direction == "out" else "<-"


def evidence(e: dict) -> str:
    kind = e["type"]
    if kind == "structural":
        return f"{e['kind']} link {_arrow(e['direction'])}, found by {e['resolution']}"
    if kind == "ghost":
        return (
            f"ghost {e['kind']} link {_arrow(e['direction'])}, cut in {e.get('severed_at')} on {e.get('severed_date')} by {e.get('severing_subject')!r}, "
            f"{e['cochanges_since']} joint changes later at confidence {e['confidence_since']:.2f}"
        )
    if kind == "cochange":
        return f"changed together {e['n']} times up to {e.get('last')}: confidence {e['confidence']:.2f}, lift {e['lift']:.1f}"
    if kind == "doc_drift":
        return f"document behind by {e['commits_behind']} commits"
    way = " via " + " > ".join(e["via"]) if e.get("via") else ""
    return f"{e['union_dist']} steps away in all links{way}, {e.get('head_dist') or 'out of reach'} over live ones"


def blast(o: dict) -> Iterator[str]:
    yield f"What a change of {o['query']['file']} may touch, as of {o['query']['head']}"
    for r in o["results"]:
        yield f"  {r['rank']:.2f}  {r['path']}"
        yield from (f"          {evidence(e)}" for e in r["evidence"])
    if not o["results"]:
        yield "  nothing reaches the threshold, which proves nothing"


def ghosts(o: dict) -> Iterator[str]:
    for g in o["results"]:
        yield f"{g['score']:.2f}  {g['from']} -> {g['to']} [{g['kind']}]"
        yield f"      cut in {_commit(g.get('severed_at'))} after {g['lifetime_days']} days; {g['cochanges_since']} joint changes later at confidence {g['confidence_since']:.2f}"
    if not o["results"]:
        yield "no ghosts found"


def cochange(o: dict) -> Iterator[str]:
    yield f"Files that change with {o['query']['file']}"
    for r in o["results"]:
        linked = ", linked" if r["structural_edge"] else ""
        yield f"  {r['path']}: {r['n']} times, confidence {r['confidence']:.2f}, lift {r['lift']:.1f}{linked}; {r['first']['date']} to {r['last']['date']}"
    if not o["results"]:
        yield "  none passes the gates"


def _hops(hops: list[dict]) -> Iterator[str]:
    for h in hops:
        state = "live" if h["alive"] else f"gone since {_commit(h['died'], False)}" if h.get("died") else "gone"
        yield f"  {h['from']} -> {h['to']} [{h['kind']}, {state}]"


def path(o: dict) -> Iterator[str]:
    if o["live_path"] is not None:
        yield f"Live path from {o['a']} to {o['b']}"
        yield from _hops(o["live_path"])
    elif o["union_path"] is not None:
        yield f"Only a path of former links leads from {o['a']} to {o['b']}"
        yield from _hops(o["union_path"])
        if o.get("broke_at"):
            yield f"  it broke in {_commit(o['broke_at'])}"
    else:
        yield f"{o['a']} and {o['b']} were never connected"


def why(o: dict) -> Iterator[str]:
    yield f"{o['a']} and {o['b']}"
    for e in o["edges"]:
        yield f"  {e['from']} -> {e['to']} [{e['kind']}, by {e['resolution']}, {'live' if e['alive'] else 'gone'}]"
        for i in e["intervals"]:
            yield f"    from {_commit(i.get('from'), False)} to {_commit(i['to']) if i.get('to') else 'now'}"
        if g := e.get("ghost"):
            yield f"    ghost since {_commit(g.get('severed'))}: lived {g['lifetime_days']} days, {g['cochanges_since']} joint changes later, confidence {g['conf_since']:.2f}, score {g['score']:.2f}"
    if c := o.get("cochange"):
        yield f"  changed together {c['n']} times, lift {c['lift']:.1f}"


def timeline(o: dict) -> Iterator[str]:
    yield o["file"]
    yield f"  first seen in {_commit(o.get('born'))}"
    if o.get("died"):
        yield f"  deleted in {_commit(o['died'])}"
    for p in o["paths"] if len(o["paths"]) > 1 else []:
        doubt = f", a rename at confidence {p['confidence']:.2f}" if p["confidence"] < 1 else ""
        yield f"  at {p['path']} from {_commit(p.get('from'), False)}{doubt}"
    for e in o["edge_events"]:
        yield f"  {_commit(e.get('commit'), False)}: {e['event']} {e['kind']} {_arrow(e['direction'])} {e['other']}"
    for c in o["churn"]:
        yield f"  {c['period']}: {c['touches']} touches of {c['lines']} lines"


def drift(o: dict) -> Iterator[str]:
    for d in o["results"]:
        yield f"{d['doc']} ({d['doc_last_touched']}) is {d['commits_behind']} commits behind {d['code']} ({d['code_last_touched']})"
    if not o["results"]:
        yield "every document is up to date"


def hotspots(o: dict) -> Iterator[str]:
    yield f"Hotspots by {o['by']}"
    yield from (f"  {h['score']:>9.2f}  {h['path']}  {h['detail']}" for h in o["results"])


def search(o: dict) -> Iterator[str]:
    yield from (f"{r['commit']['oid']} {r['commit']['date']} {r['author']}: {r['commit']['subject']}" for r in o["results"])


def stats(o: dict) -> Iterator[str]:
    c, f, e, i, r = o["commits"], o["files"], o["edges"], o["imports"], o["renames"]
    yield f"indexed up to {o['head']} at {o.get('indexed_at') or 'an unknown time'}"
    yield f"commits  {c['total']}: {c['excluded_too_large']} too large, {c['excluded_mechanical']} mechanical, {c['merges']} merges; {c['excluded_pct']} % don't count"
    yield f"files    {f['total']}: {f['alive']} alive, {f['dead']} dead, {f['docs']} documents"
    yield f"links    {e['total']}: {e['live']} live, {e['ghosts']} ghosts; {o['cochange_pairs']} pairs change together"
    yield f"imports  {i['total']}: {i['resolved']} resolved, ratio of unresolved {i['unresolved_ratio']}"
    yield f"renames  {r['total']}: {r['low_confidence']} of low confidence"


def index(o: dict) -> Iterator[str]:
    yield f"{o['commits_indexed']} commits indexed"


_FORMS: dict[str, Callable[[dict], Iterator[str]]] = {f.__name__: f
    for f in (blast, ghosts, cochange, path, why, timeline, drift, hotspots, search, stats, index)}


def render(command: str, answer: dict) -> list[str]:
    """Lines for a command's answer, cut-off mark and notes included."""
    lines = list(_FORMS[command](answer))
    if answer.get("truncated"):
        lines.append(CUT_OFF)
    return lines + [f"note: {c}" for c in answer.get("caveats", [])]
