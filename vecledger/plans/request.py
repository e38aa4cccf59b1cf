"""Query requests: validation, defaults and strategies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum
from typing import Any

from vecledger.functions.filters import MetadataFilter


class SearchStrategy(IntEnum):
    DEFAULT = 0
    EXACT = 1
    FAST = 2
    PRECISE = 3
    BATCH = 4


@dataclass(frozen=True)
class SearchParams:
    hnsw_ef: int = 0
    exact: bool = False
    indexed_only: bool = False
    use_quantization: bool = False
    search_strategy: SearchStrategy = SearchStrategy.DEFAULT
    score_threshold: float = 0.0

    @staticmethod
    def default() -> SearchParams:
        return SearchParams(hnsw_ef=100)

    @staticmethod
    def fast() -> SearchParams:
        return SearchParams(hnsw_ef=40, search_strategy=SearchStrategy.FAST)

    @staticmethod
    def precise() -> SearchParams:
        return SearchParams(hnsw_ef=300, search_strategy=SearchStrategy.PRECISE)

    def adjusted(self) -> SearchParams:
        """Parameters as the strategy sets them: an ef of 0 is filled in, a given one stays."""
        s = self.search_strategy
        if s == SearchStrategy.EXACT:
            return replace(self, exact=True, hnsw_ef=0)
        if s == SearchStrategy.FAST:
            return replace(self, exact=False, hnsw_ef=self.hnsw_ef or 40)
        if s == SearchStrategy.PRECISE:
            return replace(self, exact=False, hnsw_ef=self.hnsw_ef or 300)
        if s == SearchStrategy.DEFAULT:
            return replace(self, exact=False, hnsw_ef=self.hnsw_ef or 100)
        return self


@dataclass(frozen=True)
class RecommendParams:
    positive: list = field(default_factory=list)
    negative: list = field(default_factory=list)
    strategy: str = "average"


@dataclass(frozen=True)
class ScrollParams:
    offset: str = ""
    limit: int = 10


@dataclass(frozen=True)
class QueryRequest:
    vector: list[float] | None = None
    point_id: Any = None
    recommend: RecommendParams | None = None
    scroll: ScrollParams | None = None
    sample: bool = False
    filter: MetadataFilter | None = None
    params: SearchParams = field(default_factory=SearchParams)
    limit: int = 10
    offset: int = 0
    with_vectors: bool = False
    with_payload: Any = None
    group_by: str = ""
    group_size: int = 0
    group_limit: int = 0
    using: str = ""
    seed: int = 0

    def normalized(self) -> QueryRequest:
        """Exactly one query type, and defaults; ValueError otherwise.

        limit <= 0 means 10. With group_by, if group_size or group_limit is not positive
        both are reset, to 1 and to the limit.
        """
        kinds = (bool(self.vector), self.point_id not in (None, ""), self.recommend is not None, self.scroll is not None, bool(self.sample))
        if sum(kinds) != 1:
            raise ValueError("a query needs exactly one of vector, point_id, recommend, scroll and sample")
        out = replace(self, limit=self.limit if self.limit > 0 else 10, params=self.params.adjusted())
        if out.group_by and (out.group_size <= 0 or out.group_limit <= 0):
            out = replace(out, group_size=1, group_limit=out.limit)
        return out

    def payload_fields(self) -> list[str] | bool:
        """True for all metadata, False for none, or the list of dotted fields to include."""
        p = self.with_payload
        if isinstance(p, bool) or p is None:
            return bool(p)
        if isinstance(p, (list, tuple)):
            return list(p) if p else False
        if isinstance(p, dict):
            return list(p["include"]) if p.get("include") else True
        return isinstance(p, str)

    def payload_excluded(self) -> list[str]:
        """Dotted fields to leave out of the metadata."""
        return list(self.with_payload.get("exclude") or []) if isinstance(self.with_payload, dict) else []

    @staticmethod
    def of(raw: dict) -> QueryRequest:
        """From JSON, with keys such as WithVectors, withvectors or with_vectors."""
        low = {k.lower().replace("_", ""): v for k, v in raw.items()}
        sub = lambda d: {k.lower().replace("_", ""): v for k, v in (d or {}).items()}
        params, rec, scroll = sub(low.get("params")), low.get("recommend"), low.get("scroll")
        return QueryRequest(
            vector=low.get("vector"), point_id=low.get("pointid"), sample=bool(low.get("sample")),
            recommend=RecommendParams(sub(rec).get("positive") or [], sub(rec).get("negative") or [], sub(rec).get("strategy") or "average") if rec else None,
            scroll=ScrollParams(str(sub(scroll).get("offset") or ""), sub(scroll).get("limit") or 10) if scroll is not None else None,
            filter=MetadataFilter.of(low.get("filter")),
            params=SearchParams(params.get("hnswef") or 0, bool(params.get("exact")), bool(params.get("indexedonly")), bool(params.get("usequantization")), SearchStrategy(params.get("searchstrategy") or 0), params.get("scorethreshold") or 0.0),
            limit=low.get("limit") or 0, offset=low.get("offset") or 0, with_vectors=bool(low.get("withvectors")), with_payload=low.get("withpayload"),
            group_by=low.get("groupby") or "", group_size=low.get("groupsize") or 0, group_limit=low.get("grouplimit") or 0, using=low.get("using") or "",
        )
