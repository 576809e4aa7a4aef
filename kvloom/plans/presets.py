"""Series of runs that are run again and again, and the data sets that they are run on."""

from __future__ import annotations

from dataclasses import replace

from kvloom.operators.spec import IndexSpec, OpSpec

#: The public key files by short name, and how many keys each has. "string" is generated.
DATASETS = {
    "fb": ("fb_200M_uint64", 200_000_000),
    "lognormal": ("lognormal_200M_uint64", 200_000_000),
    "uniform_sparse": ("uniform_sparse_200M_uint64", 200_000_000),
    "uniform_dense": ("uniform_dense_200M_uint64", 200_000_000),
    "normal": ("normal_200M_uint64", 200_000_000),
    "wiki": ("wiki_ts_200M_uint64", 200_000_000),
    "osm": ("osm_cellids_800M_uint64", 800_000_000),
    "books": ("books_800M_uint64", 800_000_000),
    "string": ("", 100_000_000),
}
RATIOS = (1, 10, 100, 1000)
#: Leaves in pages of the block index for keys of each kind.
LEAF_PAGES = {"uint64": 16, "str": 32}


def _tables(folder: str, dataset: str, data: str, ratios: tuple, num_keys: int | None, key_type: str) -> list[OpSpec]:
    """The inner table, and an outer one for each ratio."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown data set {dataset!r}; known: {', '.join(DATASETS)}")
    source, n = DATASETS[dataset]
    n = num_keys or n
    if key_type == "str":
        made = [OpSpec("create_input", method="string", num_keys=n, name="inner", result_path=f"{folder}/inner", create_indexes=True, key_type="str", key_size=16, value_size=16)]
        return made + [OpSpec("create_input", method="string", source=f"{folder}/inner", num_keys=-(-n // r), fraction_of_keys=r, name=f"input{r}", result_path=f"{folder}/input{r}", ratio=r, key_type="str", key_size=16, value_size=16) for r in ratios]
    base = OpSpec("create_input", source=f"{data}/{source}.keys", num_keys=n, name="inner", result_path=f"{folder}/inner", create_indexes=True)
    return [base] + [replace(base, name=f"input{r}", num_keys=-(-n // r), fraction_of_keys=r, ratio=r, result_path=f"{folder}/input{r}", create_indexes=False) for r in ratios]


def _runs(folder: str, out: str, algos: list[tuple[str, IndexSpec | None]], ratios: tuple, threads: int, repeats: int, checksum: bool, key_type: str = "uint64", size: int = 8) -> list[OpSpec]:
    """Each algo on each ratio, repeats + 1 times."""
    runs = []
    for r in range(repeats + 1):
        for ratio in ratios:
            for algo, index in algos:
                name = f"{algo}_{index.type}" if index else algo
                runs.append(OpSpec(algo, f"{folder}/inner", f"{folder}/input{ratio}", f"{out}/{name}_run_{r}_ratio_{ratio}", f"{name}{ratio}run_{r}", key_type, threads, ratio, checksum, index=index, algo_name=name, key_size=size, value_size=size, extra={"repeat": r}))
    return runs


def merges(folder: str, out: str, dataset: str = "fb", data: str = ".", threads: int = 1, repeats: int = 0, ratios: tuple = RATIOS, num_keys: int | None = None, checksum: bool = False) -> tuple[list[OpSpec], list[OpSpec]]:
    """(inputs, runs): the standard merge, and the learned one by each of its indexes."""
    leaf = {"type": "btree", "leaf_size_in_pages": LEAF_PAGES["uint64"], "epsilon": 4096}
    algos = [("learned_merge", IndexSpec.named("flatpgm256")), ("learned_merge", IndexSpec.named("sampledflatpgm256")), ("learned_merge", IndexSpec.from_dict(leaf)), ("standard_merge", None)]
    return _tables(folder, dataset, data, ratios, num_keys, "uint64"), _runs(folder, out, algos, ratios, threads, repeats, checksum)


def string_joins(folder: str, out: str, threads: int = 1, repeats: int = 0, ratios: tuple = RATIOS, num_keys: int | None = None) -> tuple[list[OpSpec], list[OpSpec]]:
    """(inputs, runs): joins of 16-byte keys, plain and by a block index."""
    leaf = IndexSpec.from_dict({"type": "btree", "leaf_size_in_pages": LEAF_PAGES["str"], "epsilon": 4096})
    algos = [("lsj", leaf), ("inlj", leaf), ("sort_join", None), ("hash_join", None)]
    return _tables(folder, "string", "", ratios, num_keys, "str"), _runs(folder, out, algos, ratios, threads, repeats, False, "str", 16)


def adaptive_joins(folder: str, out: str, dataset: str = "fb", data: str = ".", threads: int = 1, repeats: int = 0, ratios: tuple = RATIOS, num_keys: int | None = None, checksum: bool = False) -> tuple[list[OpSpec], list[OpSpec]]:
    """(inputs, runs): the join by a membership index."""
    return _tables(folder, dataset, data, ratios, num_keys, "uint64"), _runs(folder, out, [("alex_inlj", IndexSpec.named("alex"))], ratios, threads, repeats, checksum)


def unsorted_joins(inner: str, outer: str, out: str, name: str = "unsorted", repeats: int = 0) -> list[OpSpec]:
    """Both joins of unsorted tables with sorted output."""
    algos = ("unsorted_inlj_sorted_output", "unsorted_lsj_sorted_output")
    return [OpSpec(a, inner, outer, f"{out}/{a}_{name}_run{r}", f"{a}_run{r}", algo_name=a, outer_index_file=f"{out}/{a}_run{r}outer_index", inner_index_file=f"{out}/{a}_run{r}inner_index", extra={"repeat": r}) for a in algos for r in range(repeats + 1)]
