"""Fixed values. They define the results, so they are data, not design; keep them in natural order."""

# Characters that count as outer whitespace of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# File extension -> record format; every other extension reads as text.
EXTENSIONS = {
    ".parquet": "parquet",
    ".jsonl": "jsonl",
    ".json": "json",
    ".csv": "csv",
    ".tsv": "tsv",
    ".txt": "txt",
    ".text": "txt",
    ".arrow": "arrow",
    ".ipc": "arrow",
}

# Extensions looked up in a directory, in document order; ".ipc" only when the format is forced to arrow.
DIRECTORY_EXTENSIONS = [".parquet", ".jsonl", ".json", ".csv", ".tsv", ".txt", ".text", ".arrow"]

# Keys tried for the content of a conversation turn after the configured one.
CONTENT_KEYS = ["value", "content", "text", "message"]

# Defaults.
BLOCK_SIZE = 1024
SHARD_TOKENS = 50_000_000
VAL_FRACTION = 0.05
MIN_CHARS = 64
MAX_CHARS = 0
SEED = 42
LINES_PER_CHUNK = 100_000
TOKENS_PER_CHAR = 0.25
PREVIEW_CHARS = 500
SYNTHETIC_VOCAB = 32_000

# Role labels of the two common chat layouts.
SHAREGPT_ROLES = {"human": "User", "gpt": "Assistant", "system": "System"}
OPENAI_ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}

_SHAREGPT = {
    "type": "conversation",
    "field": "conversations",
    "role_key": "from",
    "content_key": "value",
    "roles": SHAREGPT_ROLES,
    "separator": "\n\n",
    "include_roles": True,
}

# Named extraction specs.
PRESETS = {
    "arxiv_tex": {"type": "field", "field": "text"},
    "gpt_oss_sft": _SHAREGPT,
    "pile_detoxify": {
        "type": "field",
        "field": "texts",
        "filters": [{"field": "avg_score", "op": "<", "value": 0.5}],
    },
    "tinystories": {"type": "field", "field": "text"},
    "openwebtext": {"type": "field", "field": "text"},
    "sharegpt": _SHAREGPT,
    "openai_messages": {
        "type": "conversation",
        "field": "messages",
        "role_key": "role",
        "content_key": "content",
        "roles": OPENAI_ROLES,
        "separator": "\n\n",
        "include_roles": True,
    },
    "alpaca": {
        "type": "template",
        "template": "### Instruction:\n{instruction}{input_section}\n\n### Response:\n{output}",
        "fields": ["instruction", "input", "output"],
        "_alpaca_mode": True,
    },
    "dolly": {
        "type": "template",
        "template": "### Instruction:\n{instruction}{context_section}\n\n### Response:\n{response}",
        "fields": ["instruction", "context", "response"],
        "_dolly_mode": True,
    },
}

# Template modes with one optional section: spec key -> (optional field, its heading, required answer field).
SECTION_MODES = {
    "_alpaca_mode": ("input", "### Input:", "output"),
    "_dolly_mode": ("context", "### Context:", "response"),
}

# Key order of the two manifest documents.
MANIFEST_KEYS = [
    "format", "tokenizer", "block_size", "vocab_size", "total_blocks", "total_tokens", "total_docs",
    "train_shards", "val_shards", "compression", "created", "source", "preset", "field_map",
]
COMBINED_KEYS = [
    "format", "tokenizer", "block_size", "total_blocks", "total_tokens", "total_docs",
    "train_shards", "val_shards", "source", "input_dirs",
]
