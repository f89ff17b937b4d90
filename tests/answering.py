"""A local HTTP server that takes messages and answers them as told."""

import contextlib
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


@contextlib.contextmanager
def answering(fails=(), rejects=()):
    """(url, chat ids in the order of the calls): the calls with a number in fails get a status of 500, those in rejects ok = false."""
    calls, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            with lock:
                calls.append(int(form["chat_id"][0]))
                n = len(calls)
            assert self.path == "/bott/sendMessage" and form["parse_mode"] == ["HTML"] and form["text"]
            self.send_response(500 if n in fails else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"ok": n not in rejects}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", calls
    finally:
        server.shutdown()
