"""The description of one run: which operator on which tables, and how. Unknown names are errors."""

from __future__ import annotations

import itertools
import random
from dataclasses import asdict, dataclass, field, replace

#: The operator, index and search names that a description may use.
JOINS = ("sort_join", "hash_join", "lsj", "inlj", "unsorted_lsj", "unsorted_inlj", "unsorted_lsj_sorted_output", "unsorted_inlj_sorted_output", "alex_inlj")
MERGES = ("standard_merge", "learned_merge")
ALGOS = ("create_input", *MERGES, *JOINS)
SEARCHES = ("linear", "binary", "exponential")
INDEXES = ("pgm", "sampledpgm", "flatpgm", "sampledflatpgm", "btree", "radixspline", "rmi", "alex")
METHODS = ("sosd", "string", "unsorted")


#: Rows of 16 bytes in a page of 4096.
PAGE_ROWS = 256


@dataclass(frozen=True)
class IndexSpec:
    type: str = "pgm"
    search: str = "binary"
    error: int = 128
    sample: int = 1
    leaf_rows: int = 256
    dataset: str = ""
    epsilon: int = 0

    def __post_init__(self):
        if self.type not in INDEXES:
            raise ValueError(f"unknown index {self.type!r}; known: {', '.join(INDEXES)}")
        if self.search not in SEARCHES:
            raise ValueError(f"unknown search {self.search!r}; known: {', '.join(SEARCHES)}")
        if self.error < 1 or self.sample < 1 or self.leaf_rows < 1:
            raise ValueError("error, sample and leaf_rows are at least 1")

    @classmethod
    def named(cls, name: str, search: str = "binary") -> IndexSpec:
        """By a name with the page of rows that its error should span: pgm256, sampledflatpgm1024, btree256, rmi, alex."""
        kind = name.rstrip("0123456789")
        page = int(name[len(kind) :] or 256)
        if kind.startswith("sampled"):
            return cls(kind, search, max(1, page // 256), 128)
        return cls(kind, search, max(1, page // 2), 1, page)

    @classmethod
    def from_dict(cls, d: dict) -> IndexSpec:
        """type and search; leaf_size_in_pages for the blocks of a btree; dataset and epsilon are kept for reports."""
        unknown = set(d) - {"type", "search", "leaf_size_in_pages", "dataset", "epsilon"}
        if unknown:
            raise ValueError(f"unknown in index: {', '.join(sorted(unknown))}")
        spec = cls.named(d.get("type", "pgm256"), d.get("search") or "binary")
        if "leaf_size_in_pages" in d:
            spec = replace(spec, leaf_rows=PAGE_ROWS * int(d["leaf_size_in_pages"]))
        return replace(spec, dataset=d.get("dataset", ""), epsilon=int(d.get("epsilon", 0)))


@dataclass(frozen=True)
class OpSpec:
    algo: str
    inner_table: str = ""
    outer_table: str = ""
    result_path: str = ""
    name: str = ""
    key_type: str = "uint64"
    num_threads: int = 1
    ratio: int = 1
    check_checksum: bool = False
    write_result_to_disk: bool = True
    load_in_mem: bool = False
    index: IndexSpec | None = None
    method: str = "sosd"
    source: str = ""
    fraction_of_keys: int = 1
    num_keys: int = 0
    create_indexes: bool = False
    key_size: int = 8
    value_size: int = 8
    algo_name: str = ""
    outer_index_file: str = ""  # of spilled buckets: Spark spills by itself, so the names are kept and not used
    inner_index_file: str = ""
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.algo not in ALGOS:
            raise ValueError(f"unknown algo {self.algo!r}; known: {', '.join(ALGOS)}")
        if self.key_type not in ("uint64", "int64", "str"):
            raise ValueError(f"unknown key_type {self.key_type!r}")
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; known: {', '.join(METHODS)}")
        if min(self.num_threads, self.fraction_of_keys, self.ratio, self.key_size, self.value_size) < 1:
            raise ValueError("num_threads, fraction_of_keys, ratio, key_size and value_size are at least 1")
        if self.algo == "create_input":
            if not self.source and not (self.method == "string" and self.num_keys):
                raise ValueError("create_input needs a source, or num_keys for random strings")
        elif not (self.inner_table and self.outer_table):
            raise ValueError(f"{self.algo} needs inner_table and outer_table")

    @classmethod
    def from_dict(cls, d: dict) -> OpSpec:
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__ and k not in ("index", "extra")}
        index = d.get("index")
        if isinstance(index, dict):
            index = IndexSpec.from_dict(index)
        if "common_key" in d and "ratio" not in known:
            known["ratio"] = d["common_key"]
        if "load_sstable_in_mem" in d:
            known["load_in_mem"] = d["load_sstable_in_mem"]
        rest = {k: v for k, v in d.items() if k not in known and k not in ("index", "common_key", "load_sstable_in_mem")}
        return cls(**known, index=index, extra=rest)

    def to_dict(self) -> dict:
        return asdict(self)


def expand(inner: str, outer_of: dict[int, str], algos: list[str], indexes: list[str], threads: list[int], repeats: int, seed: int | None = None) -> list[OpSpec]:
    """Every run of a series: each algo (those by index with each index) on each ratio and thread count, repeats + 1 times.

    A seed shuffles the order, so that slow drifts of the machine don't fall on one algo.
    """
    out = []
    for algo, ratio, n in itertools.product(algos, outer_of, threads):
        base = OpSpec(algo, inner, outer_of[ratio], ratio=ratio, num_threads=n, name=algo)
        by_index = [replace(base, index=IndexSpec.named(x), name=f"{algo}_{x}") for x in indexes] if algo in ("lsj", "inlj", "learned_merge") else [base]
        out += [replace(s, extra={"repeat": r}) for s in by_index for r in range(repeats + 1)]
    if seed is not None:
        random.Random(seed).shuffle(out)
    return out
