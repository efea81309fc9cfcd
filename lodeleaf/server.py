"""HTTP interface, on the standard library."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodeleaf.config import Config


def config_from_environment(config: Config) -> Config:
    """Endpoint settings that the environment gives."""
    names = {"LODELEAF_LLM_BASE_URL": "llm_base_url", "LODELEAF_LLM_API_KEY": "llm_api_key", "LODELEAF_LLM_MODEL": "llm_model"}
    return config.but(**{field: os.environ[name] for name, field in names.items() if os.environ.get(name)})


def labels(value: str | list | None) -> list[str] | None:
    """Access labels of a request: a list, or a string with commas; null for all."""
    if value is None or isinstance(value, list):
        return value
    return [x for part in str(value).split(",") if (x := part.strip())]


def handle(engine, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and reply of a request."""
    try:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/stats"):
            return 200, engine.stats()
        if (method, path) == ("GET", "/audit/verify"):
            ok, message = engine.audit_verify()
            return 200, {"ok": ok, "message": message}
        if (method, path) == ("POST", "/index"):
            acl = body.get("acl") or engine.config.default_acl
            if "," in acl:
                return 422, {"error": "acl must be one label"}
            return 200, {"results": engine.index_paths(body["paths"], acl)}
        if (method, path) == ("POST", "/query"):
            answer = engine.ask(body["query"], labels(body.get("acl", engine.config.default_acl)), body.get("top_k"), None, body.get("history"), body.get("domain_terms"), body.get("reasoning"))
            return 200, answer.to_dict()
    except KeyError as e:
        return 422, {"error": f"missing field {e.args[0]}"}
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}
    return 404, {"error": "not found"}


def make_server(engine, host: str = "127.0.0.1", port: int = 8070) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, out = handle(engine, method, self.path.split("?")[0], json.loads(raw) if raw else {})
            except json.JSONDecodeError:
                status, out = 400, {"error": "not valid JSON"}
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine, host: str = "127.0.0.1", port: int = 8070) -> None:
    with make_server(engine, host, port) as server:
        server.serve_forever()
