"""Settings handed to the operators. Every value has the default of a nightly production run."""

from __future__ import annotations

from dataclasses import dataclass

# Limits, scoring constants and output formats that decide the results.
MAX_LISTED = 50
CHUNK_SIZE = 512
MAX_DOCUMENT_TOKENS = 102_400
EMBEDDING_WIDTH = 768
BM25_K1 = 1.5
BM25_B = 0.75
DENSE_CUT = 250
TOP_K = 3
RELEVANCE_THRESHOLD = 0.9
MODEL_BATCH = 32
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
VIDEO_URL_PREFIX = "https://youtu.be/"
VIDEO_SEARCH_URL = "https://www.youtube.com/results?search_query"
DELIMITER = "===================="
FUSION_CONSTANT = 60

# Fixed value: the frame around the retrieved entries and the question.
USER_TEMPLATE = """Use the following information:

```
{context}
```

to respond to the query: {query}
"""

# The two longer templates are deployment settings; the document comes before the chunk so that all
# prompts of one document share a prefix. The placeholders' names are fixed values.
CONTEXT_TEMPLATE = """<document>
{transcript}
</document>

<chunk>
{chunk}
</chunk>

Say in two to four sentences what this chunk is about and where it stands in the document, so that
a search can find it. Give the context only.
"""

SYSTEM_TEMPLATE = """Answer from the entries below, which are separated by {delimiter}. Every entry has a TITLE, a URL,
START and END marks as fractions of the length, and an EXCERPT that opens with a short written
summary. Cite TITLE, URL, START and END of every entry you use and claim nothing they do not say.
If there is no entry, or none fits, say so, answer from general knowledge with sources, and point
to {youtube_search_url}={query}.
"""

EMPTY_ANSWER = "No answer was produced. Please try again."


@dataclass(frozen=True)
class IndexSettings:
    chunk_size: int = CHUNK_SIZE
    max_document_tokens: int = MAX_DOCUMENT_TOKENS
    embedding_width: int = EMBEDDING_WIDTH
    k1: float = BM25_K1
    b: float = BM25_B

    @property
    def overlap(self) -> int:
        return self.chunk_size // 10

    @property
    def stride(self) -> int:
        return self.chunk_size - self.overlap


@dataclass(frozen=True)
class SearchSettings:
    k: int = TOP_K
    threshold: float = RELEVANCE_THRESHOLD
    dense_cut: int = DENSE_CUT
    url_prefix: str = VIDEO_URL_PREFIX
