"""The same functions over HTTP: /, /api/health, stats, index (a path, or an upload), retrieve, query."""

from __future__ import annotations

import email
import email.policy
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from docweft.config import Config
from docweft.operators import generate, vectors
from docweft.plans import pipelines
from docweft.sources import files


def respond(spark: SparkSession, cfg: Config, path: str, body: dict) -> tuple[int, dict]:
    """Status and answer of a request."""
    if path == "/":
        return 200, {"service": "docweft", "endpoints": [f"/api/{x}" for x in ("health", "stats", "index", "retrieve", "query")]}
    if path == "/api/health":
        return 200, {"status": "ok"}
    if path == "/api/stats":
        return 200, pipelines.stats(spark, cfg)
    if path == "/api/index" and "content" in body:
        name = body.get("filename") or "upload.bin"
        if name.rsplit(".", 1)[-1].lower() not in files.SUPPORTED:
            return 415, {"detail": f"no support for {name}; there is for {', '.join(files.SUPPORTED)}"}
        n, errors = pipelines.index_upload(spark, name, body["content"], cfg)
        return 200, {"total_indexed": n, "sources_succeeded": int(not errors), "sources_failed": len(errors), "errors": errors, "filename": name}
    if path == "/api/index":
        return 200, {"total_indexed": pipelines.index(spark, body["path"], cfg, int(body.get("min_quality", 0)))}
    if path not in ("/api/retrieve", "/api/query"):
        return 404, {"detail": "no such path"}
    if not str(body.get("question", "")).strip():
        return 422, {"detail": "question is needed"}
    records = vectors.Store(spark, cfg.store.path, cfg.store.collection).read()
    if records is None:
        return 200, {"question": body["question"], "total": 0, "chunks": [], "answer": generate.NO_ANSWER}
    q = spark.createDataFrame([(0, body["question"])], "query_id int, question string")
    hits = pipelines.retrieve(records, q, cfg, body.get("top_k"), body.get("score_threshold"), body.get("document_id"))
    shown = [r.asDict() for r in generate.sources(hits, "api").orderBy("rank").collect()]
    if path == "/api/retrieve":
        return 200, {"question": body["question"], "total": len(shown), "chunks": shown}
    got = generate.answers(generate.prompts(q, hits), generate.get_llm(cfg.llm), cfg.llm.model).first()
    return 200, {"question": body["question"], "answer": got["answer"], "model": got["model"], "sources": shown}


def form(kind: str, data: bytes) -> dict:
    """Body of a request: JSON, or the fields of a form whose file becomes ``filename, content``."""
    if not kind.startswith("multipart/form-data"):
        return json.loads(data or b"{}")
    message = email.message_from_bytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + data, policy=email.policy.HTTP)
    out: dict = {}
    for part in message.iter_parts():
        value = part.get_payload(decode=True) or b""
        if part.get_filename() is not None:
            out |= {"filename": PurePosixPath(part.get_filename().replace("\\", "/")).name, "content": value}
        else:
            out[part.get_param("name", header="content-disposition")] = value.decode("utf-8", "replace")
    return out


def serve(spark: SparkSession, cfg: Config, port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                status, out = respond(spark, cfg, self.path, form(self.headers.get("Content-Type") or "", self.rfile.read(size)))
            except Exception as e:
                status, out = 500, {"detail": f"{type(e).__name__}: {e}"}
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
