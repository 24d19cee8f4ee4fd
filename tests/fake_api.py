"""A paged API over a JSON file, for workers: fake://<folder of rows.json>. Every request is logged beside the rows."""

import json
import os
import re
from urllib.parse import parse_qs, urlsplit


def _holds(row, part):
    name, asked = part.strip("()").split(":", 1)
    value = row.get(name)
    if asked.startswith("("):
        return any(str(value).lower() == a.strip('"').lower() for a in re.split(" OR ", asked.strip("()")))
    if m := re.match(r"(>=|<=|>|<)(.*)", asked):
        if value is None:
            return False
        a, b = float(value), float(m[2])
        return {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[m[1]]
    return str(value).lower() == asked.strip('"').lower()  # looser than equality, as search engines are


def transport(url):
    folder, asked = urlsplit(url).path, {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    with open(f"{folder}/log", "a") as f:
        f.write(json.dumps(asked) + "\n")
    with open(f"{folder}/rows.json") as f:
        rows = json.load(f)
    if os.path.exists(f"{folder}/flaky"):
        try:
            open(f"{folder}/failed-{asked.get('page', 0)}", "x").close()
            return 503, {}, b""
        except FileExistsError:
            pass
    if "qs" in asked:
        rows = [r for r in rows if all(_holds(r, p) for p in re.split(r" AND ", asked["qs"]))]
    total, size, page = len(rows), int(asked["size"]), int(asked.get("page", 1))
    rows = rows[(page - 1) * size : page * size]
    if os.path.exists(f"{folder}/short") and page == 2:
        rows = rows[:-1]
    if os.path.exists(f"{folder}/growing") and page == 2:
        total += 1
    if "select" in asked:
        rows = [{k: r[k] for k in asked["select"].split(",") if k in r} for r in rows]
    return 200, {}, json.dumps({"total": total, "results": rows}).encode()
