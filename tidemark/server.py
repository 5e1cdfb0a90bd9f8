"""Tool functions over a store, returning plain values; serve() registers them with a protocol server if one is installed."""

from __future__ import annotations

from .memory import FactStore


def tools(store: FactStore) -> dict:
    def remember(content: str, entities: list[str] | None = None, source: str = "") -> str:
        """Store a fact; what it contradicts is deprecated."""
        return f"stored {store.remember(content, entities or [], source=source)}"

    def query(question: str, k: int = 5) -> list[dict]:
        """The facts that answer a question best."""
        return [{"content": r["content"], "score": round(r["score"], 4), "id": r["id"]} for r in store.query(question, k)]

    def timeline(entity: str) -> list[dict]:
        """How knowledge about an entity evolved."""
        return [{"content": r.content, "effective_at": str(r.effective_at), "created_at": str(r.created_at), "deprecated": r.deprecated} for r in store.timeline(entity).collect()]

    return {"remember": remember, "query": query, "timeline": timeline}


def serve(store: FactStore, name: str = "tidemark") -> None:
    """Runs a protocol server with these tools; it needs the optional package `mcp`."""
    try:
        from mcp.server.fastmcp import FastMCP
    except ModuleNotFoundError as missing:
        raise SystemExit("the package mcp is not installed") from missing
    server = FastMCP(name)
    for tool in tools(store).values():
        server.tool()(tool)
    server.run()
