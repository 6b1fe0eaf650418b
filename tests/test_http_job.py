import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from changeflow.plans import job
from changeflow.plans.config import Plugin


class Once(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'[{"a": 1}, {"a": 2}]')

    def log_message(self, *_):
        pass


def test_http_source_of_a_job(spark):
    server = HTTPServer(("127.0.0.1", 0), Once)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert job.source(spark, Plugin("Http", {"url": f"http://127.0.0.1:{server.server_port}/"})).count() == 2
    finally:
        server.shutdown()
