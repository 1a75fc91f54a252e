"""A web page of the living graph on this machine only: `/` is the page, `/data.json` its data, read anew for each request."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

HOST, PORT = "127.0.0.1", 7250
_POLICY = "default-src 'none'; script-src 'unsafe-inline'; style-src 'unsafe-inline'"
PAGE = """<!doctype html><meta charset="utf-8"><title>history</title>
<style>body{margin:0;font:13px sans-serif;background:#fff;color:#222}canvas{display:block}#top{position:fixed;left:8px;top:8px}</style>
<div id="top"></div><canvas></canvas><script type="application/json" id="data">__GRAPH__</script><script>
const g = JSON.parse(document.getElementById('data').textContent), c = document.querySelector('canvas'), p = c.getContext('2d');
c.width = innerWidth; c.height = innerHeight;
const colour = i => `hsl(${i * 45} 60% 45%)`, ring = Math.min(c.width, c.height) * 0.42;
const at = g.nodes.map((n, i) => { const a = 2 * Math.PI * i / g.nodes.length; return [c.width / 2 + ring * Math.cos(a), c.height / 2 + ring * Math.sin(a)]; });
const draw = (pairs, style, dash) => { p.strokeStyle = style; p.setLineDash(dash); for (const [a, b] of pairs) { p.beginPath(); p.moveTo(...at[a]); p.lineTo(...at[b]); p.stroke(); } };
draw(g.co, '#ddd', []); draw(g.live, '#888', []); draw(g.hidden, '#c33', [4, 3]); p.setLineDash([]);
g.nodes.forEach((n, i) => { p.fillStyle = colour(n[1]); p.beginPath(); p.arc(...at[i], 2 + Math.sqrt(n[2]), 0, 7); p.fill(); });
document.getElementById('top').textContent = `${g.meta.repo} ${g.meta.head || ''}: ${g.meta.files} files, ${g.meta.live} links, ${g.hidden.length} hidden couplings; ${g.groups.join(', ')}`;
</script>"""


def page(data: dict) -> str:
    """The page with its data; no tag can end inside the data block."""
    return PAGE.replace("__GRAPH__", json.dumps(data).replace("</", "<\\/"))


def server(data: Callable[[], dict], port: int = PORT) -> ThreadingHTTPServer:
    """A server bound to this machine; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            kind, status = "text/plain; charset=utf-8", 200
            try:
                if self.path in ("/", "/index.html"):
                    kind, body = "text/html; charset=utf-8", page(data())
                elif self.path == "/data.json":
                    kind, body = "application/json", json.dumps(data())
                else:
                    status, body = 404, "no such page"
            except Exception as e:
                status, body = 500, f"{type(e).__name__}: {e}"
            raw = body.encode()
            self.send_response(status)
            for name, value in (("Content-Type", kind), ("Content-Length", str(len(raw))), ("Cache-Control", "no-store"), ("Content-Security-Policy", _POLICY)):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((HOST, port), Handler)
