"""Records from external stores: JDBC tables, and clients that are asked in batches of ids."""

from __future__ import annotations

import importlib
import json
import os
import re
import urllib.parse
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators import hydrate

RECORD = "chunk_id string, text string, source_doc string, page_num int, section string, metadata string"
COLUMNS = [f.split()[0] for f in RECORD.split(", ")]
IDENTIFIER = re.compile(r"(?a)^[^\W\d]\w*(?:\.[^\W\d]\w*)?$")
ALIASES = {"postgres": "neon", "postgresql": "neon", "pg": "neon", "chromadb": "chroma"}
REQUIRED = {"supabase": ("url", "key", "table"), "pinecone": ("api_key", "index"), "qdrant": ("url", "collection"), "neon": ("dsn", "table"), "chroma": ("collection",)}
#: Ids that are sent to a database at most, and in one query.
MOST_IDS, IDS_A_QUERY = 20_000, 500
#: The order in which the environment is searched, and the variable that speaks for each store.
ENVIRONMENT = {"supabase": "SUPABASE_URL", "pinecone": "PINECONE_API_KEY", "qdrant": "QDRANT_URL", "neon": "DATABASE_URL", "chroma": "CHROMA_PATH"}


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a plain SQL name: {name}")
    return name


def detect_environment(env: Mapping[str, str] | None = None) -> str | None:
    env = os.environ if env is None else env
    return next((k for k, v in ENVIRONMENT.items() if env.get(v)), None)


def resolve(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """``$NAME`` and ``${NAME}`` in strings, read from the environment; a missing one is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if not isinstance(value, str):
        return value

    def read(m: re.Match) -> str:
        name = m.group(1) or m.group(2)
        if name not in env:
            raise ValueError(f"environment variable {name} isn't set")
        return env[name]

    return re.sub(r"\$\{(\w+)\}|\$(\w+)", read, value)


def load_config(path_or_dict: str | dict, env: Mapping[str, str] | None = None) -> dict:
    """An adapter config: known backend, required options there, environment resolved."""
    config = path_or_dict
    if isinstance(config, str):
        with open(config) as f:
            config = json.load(f)
    backend = str(config.get("backend", "")).lower()
    backend = ALIASES.get(backend, backend)
    if backend not in REQUIRED:
        raise ValueError(f"unknown backend {backend!r}")
    options = resolve(config.get("options", {}), env)
    missing = [k for k in REQUIRED[backend] if not options.get(k)]
    if missing:
        raise ValueError(f"{backend} needs {', '.join(missing)}")
    return {"backend": backend, "options": options}


def save_config(config: dict, path: str) -> None:
    load_config(config, {v: "x" for v in re.findall(r"\$\{?(\w+)", json.dumps(config))})
    with open(path, "w") as f:
        json.dump(config, f, indent=1)


def jdbc_records(spark: SparkSession, ids: DataFrame, url: str, table: str, columns: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Records of a JDBC table for some ids.

    Up to ``MOST_IDS`` ids are sent to the database, ``IDS_A_QUERY`` in each of the queries that run in parallel. Beyond that the
    table is read (in parallel where partition options are given) and joined with the ids.
    """
    names = {c: identifier((columns or {}).get(c, c)) for c in COLUMNS}
    wanted = [r[0] for r in ids.select("chunk_id").where("chunk_id is not null").distinct().limit(MOST_IDS + 1).collect()]
    rows = spark.read.format("jdbc").options(url=url, dbtable=identifier(table), **options).load()
    if len(wanted) <= MOST_IDS:
        # such a filter is part of the query that the database runs
        own = F.col(names["chunk_id"])
        some = [rows.where(own.isin(wanted[i : i + IDS_A_QUERY])) for i in range(0, len(wanted), IDS_A_QUERY)]
        rows = reduce(DataFrame.unionByName, some) if some else rows.where(F.lit(False))
    rows = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast("int" if c == "page_num" else "string").alias(c) for c, n in names.items()))
    return rows if len(wanted) <= MOST_IDS else rows.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def _records_of(answer: Any) -> Iterable[Mapping]:
    """The records in whatever shape a store's client answers."""
    if answer is None:
        return []
    if isinstance(answer, Mapping):
        if "ids" in answer and "documents" in answer:
            flat = lambda x: x[0] if x and isinstance(x[0], list) else x or []
            ids, texts = flat(answer["ids"]), flat(answer["documents"])
            metas = flat(answer.get("metadatas")) or [None] * len(ids)
            return [{"chunk_id": i, "text": t, "metadata": m or {}} for i, t, m in zip(ids, texts, metas)]
        for key in ("vectors", "result", "points", "records", "matches", "data"):
            if answer.get(key) is not None:
                inner = answer[key]
                return [{"id": k, **_plain(v)} for k, v in inner.items()] if isinstance(inner, Mapping) else _records_of(inner)
        return [answer]
    for key in ("vectors", "result", "points", "records", "matches", "data"):
        if getattr(answer, key, None) is not None and not isinstance(answer, (list, tuple)):
            return _records_of({key: getattr(answer, key)})
    return [_plain(x) for x in answer]


def _plain(x: Any) -> Mapping:
    return x if isinstance(x, Mapping) else {k: getattr(x, k) for k in ("chunk_id", "id", "text", "payload", "metadata", "source_doc", "page_num", "section") if hasattr(x, k)}


def caller(backend: Any) -> Callable[[list[str]], Any]:
    """How a backend is asked: a mapping by key, a callable, or an object with fetch, retrieve or get."""
    if isinstance(backend, Mapping):
        return lambda ids: [{"chunk_id": i, **_plain(backend[i])} for i in ids if i in backend]
    for name in "fetch retrieve get".split():
        if callable(getattr(backend, name, None)):
            return getattr(backend, name)
    if callable(backend):
        return backend
    raise ValueError("the backend can't be asked for records")


def coerce(raw: Mapping) -> dict:
    """One record from a mapping with any of the known key names."""
    from quillvec.operators import hydrate as h

    meta = next((raw[k] for k in h.METAS if isinstance(raw.get(k), Mapping)), {})
    pick = lambda names, *places: next((p[n] for p in places for n in names if p.get(n) not in (None, "")), None)
    cid = pick(h.IDS, raw) or pick(h.META_IDS, meta)
    text = pick(h.TEXTS, raw, meta)
    if cid is None or text is None:
        raise ValueError("a record needs an id and a text")
    page, section = pick(h.PAGES, raw, meta), pick(("section",), raw, meta)
    reserved = {*h.IDS, *h.TEXTS, *h.PAGES, *h.SOURCES, "section"}
    kept = {k: v for k, v in meta.items() if k not in reserved} | ({"section": section} if section else {})
    return {"chunk_id": str(cid), "text": str(text), "source_doc": pick(h.SOURCES, raw, meta), "page_num": None if page is None else int(page), "section": section, "metadata": json.dumps(kept)}


def fetch_records(ids: DataFrame, backend: Any, batch: int = 256, made: bool = False) -> DataFrame:
    """Records of distinct ids, asked for in batches by the executors; missing ones have no row.

    With ``made``, ``backend`` is called in each partition and gives what is asked.
    """
    ask_ = None if made else caller(backend)

    def run(frames):
        ask = caller(backend()) if made else ask_
        for pdf in frames:
            wanted = pdf["chunk_id"].tolist()
            rows = []
            for i in range(0, len(wanted), batch):
                some = wanted[i : i + batch]
                rows += [r for r in (coerce(x) for x in _records_of(ask(some))) if r["chunk_id"] in set(some)]
            frame = pd.DataFrame(rows, columns=COLUMNS)
            yield frame.astype({"page_num": "Int32"})

    return ids.select("chunk_id").distinct().mapInPandas(run, RECORD)


def _client(name: str, module: str, make: Callable[[Any], Any]) -> Any:
    """A store's client from its library, where that is installed."""
    try:
        return make(importlib.import_module(module))
    except ImportError:
        raise ValueError(f"no client library for {name} here; pass a client") from None


def supabase(client: Any, table: str, id_column: str = "chunk_id") -> Callable[[list[str]], Any]:
    """A table of rows behind a query builder."""
    return lambda ids: client.table(identifier(table)).select("*").in_(identifier(id_column), ids).execute()


def pinecone(client: Any, namespace: str | None = None) -> Callable[[list[str]], Any]:
    return lambda ids: client.fetch(ids=ids, **({} if namespace is None else {"namespace": namespace}))


def qdrant(client: Any, collection: str) -> Callable[[list[str]], Any]:
    """Points by id; ids that are whole numbers are asked for as numbers, as such points are."""
    number = lambda i: int(i) if i.isdigit() else i
    return lambda ids: client.retrieve(collection_name=collection, ids=[number(i) for i in ids], with_payload=True, with_vectors=False)


def chroma(collection: Any) -> Callable[[list[str]], Any]:
    return lambda ids: collection.get(ids=ids, include=["documents", "metadatas"])


def asker(backend: str, options: Mapping[str, Any], client: Any = None) -> Callable[[list[str]], Any]:
    """How a configured store is asked for ids; without a client, one is made by the store's library."""
    o = options
    if backend == "supabase":
        client = client or _client(backend, "supabase", lambda m: m.create_client(o["url"], o["key"]))
        return supabase(client, o["table"], o.get("id_column", "chunk_id"))
    if backend == "pinecone":
        client = client or _client(backend, "pinecone", lambda m: m.Pinecone(api_key=o["api_key"]).Index(o["index"]))
        return pinecone(client, o.get("namespace"))
    if backend == "qdrant":
        client = client or _client(backend, "qdrant_client", lambda m: m.QdrantClient(url=o["url"], api_key=o.get("api_key")))
        return qdrant(client, o["collection"])
    if backend == "chroma":
        client = client or _client(backend, "chromadb", lambda m: (m.PersistentClient(o["path"]) if o.get("path") else m.HttpClient(host=o.get("host", "localhost"))).get_collection(o["collection"]))
        return chroma(client)
    raise ValueError(f"{backend} isn't asked through a client")


def from_config(spark: SparkSession, config: dict, client: Callable[[], Any] | None = None) -> hydrate.Source:
    """The records of a configured store, as a source that is asked for the ids that are needed.

    Clients are made where they are used, once for each partition; ``client`` makes one in place of the store's library.
    """
    config = load_config(config)
    backend, options = config["backend"], config["options"]
    if backend == "neon":
        url = options["dsn"]
        return hydrate.Source(lambda ids: jdbc_records(spark, ids, url if url.startswith("jdbc:") else jdbc_url(url), options["table"], options.get("columns")))
    if client is None:
        asker(backend, options)  # a missing library is an error now, not in some task
    return hydrate.Source(lambda ids: fetch_records(ids, lambda: asker(backend, options, client() if client else None), made=True))


def jdbc_url(dsn: str) -> str:
    """``postgresql://user:password@host/name`` as a JDBC URL."""
    u = urllib.parse.urlsplit(dsn)
    if u.scheme not in ("postgres", "postgresql") or not u.hostname:
        raise ValueError("dsn must be a jdbc: or postgresql:// URL")
    keys = {k: v for k, v in (("user", u.username), ("password", u.password)) if v}
    query = "&".join(x for x in (u.query, urllib.parse.urlencode({k: urllib.parse.unquote(v) for k, v in keys.items()})) if x)
    return f"jdbc:postgresql://{u.hostname}{f':{u.port}' if u.port else ''}{u.path}{'?' + query if query else ''}"
