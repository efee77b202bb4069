"""Extension points: parsers, embedders, rerankers, models and stores by kind and name."""

from __future__ import annotations

from collections.abc import Callable

# The kinds of extension, and the default of each.
KINDS = ("parser", "processor", "embedder", "reranker", "vector_store", "graph_store", "llm")
DEFAULTS = {"parser": "text", "embedder": "hash", "reranker": "overlap", "vector_store": "frame", "graph_store": "frame", "llm": "echo", "processor": "none"}


class Registry:
    """Factories by kind and name; an instance is made once per knowledge base."""

    def __init__(self) -> None:
        self._factories: dict[tuple[str, str], tuple[Callable, frozenset[str]]] = {}
        self._made: dict[tuple[str, str, str], object] = {}

    def register(self, kind: str, name: str, factory: Callable, abilities: tuple[str, ...] = ()) -> None:
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        self._factories[(kind, name)] = (factory, frozenset(abilities))

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._factories if k == kind)

    def resolve(self, kind: str, name: str | None = None, kb_id: str = "", needs: tuple[str, ...] = ()) -> object:
        """The instance; raises ``LookupError`` where it is missing or lacks an ability."""
        name = name or DEFAULTS[kind]
        if (kind, name) not in self._factories:
            raise LookupError(f"no {kind} named {name}")
        factory, has = self._factories[(kind, name)]
        if not set(needs) <= has:
            raise LookupError(f"{kind} {name} lacks {sorted(set(needs) - has)}")
        at = (kind, name, kb_id)
        if at not in self._made:
            self._made[at] = factory()
        return self._made[at]


def default_registry() -> Registry:
    """The built-in extensions."""
    from lodestone.operators import graph, ingest, search, texts

    r = Registry()
    r.register("parser", "text", lambda: ingest.parse, ("text/plain", "text/markdown"))
    r.register("embedder", "hash", lambda: texts.hash_embedding, ("batch",))
    r.register("reranker", "overlap", lambda: search.overlap_rerank)
    r.register("vector_store", "frame", lambda: search.dense_topk, ("dense", "keyword", "filter"))
    r.register("graph_store", "frame", lambda: graph.neighbours, ("neighbours", "topics"))
    r.register("llm", "echo", lambda: lambda prompt: prompt)
    r.register("processor", "none", lambda: lambda atoms: atoms)
    return r
