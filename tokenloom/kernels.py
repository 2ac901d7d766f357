"""Small task-side helpers. Spark partitions, shuffles and sorts; these work on one batch of it."""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --- dictionary lookup -------------------------------------------------------------------


def find_pieces(flat, tokens, ids):
    """Ids of pieces, null where the dictionary (two Arrow arrays) lacks one. Each distinct piece is looked up once."""
    coded = flat.dictionary_encode()
    known = pc.index_in(coded.dictionary.cast(tokens.type), value_set=tokens)
    return ids.take(known).take(coded.indices)


def lookup_ids(pieces, tokens, ids, unk_id, strict):
    """Map a list<string> array to list<int32>; pieces outside the dictionary give ``unk_id``,
    or fail the task when ``strict``."""
    flat = pieces.flatten()
    found = find_pieces(flat, tokens, ids)
    if unk_id is not None:
        found = found.fill_null(unk_id)
    elif strict and found.null_count:
        unknown = flat.filter(pc.is_null(found))[0].as_py()
        raise ValueError(f"the token dictionary lacks the piece {unknown!r}")
    lengths = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(_offsets(lengths), found)


def lookup_known(pieces, tokens, ids):
    """Of a list<string> array: the ids, null where the dictionary lacks a piece, and the pieces it lacks, in order."""
    flat = pieces.flatten()
    found = find_pieces(flat, tokens, ids)
    lacks = pc.is_null(found)
    lengths = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    offsets = _offsets(lengths)
    before = _offsets(lacks.to_numpy(zero_copy_only=False)).take(offsets)
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(before, flat.filter(lacks))], ["ids", "missing"])


def tokenize_pieces(pieces, tokenize):
    """Map a list<string> array to list<int32>, tokenizing each distinct piece once."""
    coded = pieces.flatten().dictionary_encode()
    ids = pa.array(tokenize(coded.dictionary.to_pylist()), pa.list_(pa.int32()))
    per_piece = ids.take(coded.indices)
    sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(per_piece).to_numpy(
        zero_copy_only=False))))
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(sizes[ends].astype(np.int32)), per_piece.flatten())


def fill_missing(ids, tail):
    """Replace the nulls of each id list, in order, by the ids of the matching ``tail`` list."""
    flat = ids.flatten()
    holes = pc.is_null(flat)
    merged = pc.replace_with_mask(flat, holes, tail.flatten().cast(flat.type))
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(_offsets(lengths), merged)


def _offsets(lengths):
    out = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=out[1:])
    return pa.array(out)


# --- greedy grouping (running total with reset) ------------------------------------------
#
# Items arrive in order, a group closes and the total restarts from zero. Two closing rules:
#   closes_after:  the group closes once its total reaches the limit (the item is included);
#   otherwise:     an item that would push the total over the limit opens the next group.


def _cut(prefix, base, limit, closes_after):
    """Index of the first item that closes (or no longer fits) a group with ``base`` before it."""
    side = "left" if closes_after else "right"
    return np.searchsorted(prefix, np.asarray(base) + limit, side=side)


def _restart_states(prefix, limit, closes_after):
    """For each start position: (open total at the end, groups closed on the way)."""
    n = len(prefix)
    bases = np.concatenate(([0], prefix))
    cuts = _cut(prefix, bases[:-1], limit, closes_after)
    total = int(prefix[-1]) if n else 0
    ends = total - bases
    exit_total, closed = memoryview(ends), memoryview(np.zeros(n + 1, dtype=np.int64))
    step = 1 if closes_after else 0
    cuts = memoryview(cuts)
    for s in range(n - 1, -1, -1):
        cut = cuts[s]
        if cut < n:
            exit_total[s] = exit_total[cut + step]
            closed[s] = closed[cut + step] + 1
    return exit_total, closed


def summarize_run(weights, limit, closes_after):
    """Transition of one ordered run: how any open total on entry leaves it.

    The outcome depends only on where the group open on entry is cut, so the table holds one
    entry per possible cut position, not one per possible total.
    """
    prefix = np.cumsum(weights, dtype=np.int64)
    exit_total, closed = _restart_states(prefix, limit, closes_after)
    last = int(_cut(prefix, 0, limit, closes_after))
    cuts = range(min(last + 1, len(prefix)))
    starts = [c + 1 if closes_after else c for c in cuts]
    return {
        "sums": prefix[: len(starts)].tolist(),
        "exits": [exit_total[s] for s in starts],
        "closes": [closed[s] + 1 for s in starts],
        "total": int(prefix[-1]),
    }


def carry_over(table, entry_total, limit, closes_after):
    """Apply a run's transition: (open total on exit, groups closed)."""
    find = bisect_left if closes_after else bisect_right
    cut = find(table["sums"], limit - entry_total)
    if cut < len(table["exits"]):
        return table["exits"][cut], table["closes"][cut]
    return entry_total + table["total"], 0


def group_run(weights, entry_total, entry_group, limit, closes_after):
    """Group number of every item of one ordered run, given the state on entry."""
    n = len(weights)
    prefix = memoryview(np.cumsum(weights, dtype=np.int64))
    find = bisect_left if closes_after else bisect_right
    starts = []
    base, low = -entry_total, 0
    while (cut := find(prefix, base + limit, low)) < n:
        start = cut + 1 if closes_after else cut
        starts.append(start)
        if start >= n:
            break
        base, low = (prefix[start - 1] if start else 0), start
    marks = np.zeros(n + 1, dtype=np.int64)
    marks[starts] = 1
    return entry_group + np.cumsum(marks[:n])


def chunk_summary(rows, limit, closes_after):
    """One-row summary of a chunk: the transition of its first run and the state it ends in."""
    rows, weights, bounds = _ordered(rows)
    first = summarize_run(weights[: bounds[1]], limit, closes_after)
    last = first
    if len(bounds) > 2:
        last = summarize_run(weights[bounds[-2]:], limit, closes_after)
    last_exit, last_closes = carry_over(last, 0, limit, closes_after)
    shards = rows["_shard"]
    row = {
        "_chunk": rows["_chunk"][0].as_py(), "first_shard": shards[0].as_py(),
        "single": len(bounds) == 2, **first, "last_shard": shards[len(shards) - 1].as_py(),
        "last_exit": last_exit, "last_closes": last_closes,
    }
    longs = pa.list_(pa.int64())
    types = {"first_shard": pa.string(), "last_shard": pa.string(), "single": pa.bool_(),
             "sums": longs, "exits": longs, "closes": longs}
    return pa.table({k: pa.array([v], types.get(k, pa.int64())) for k, v in row.items()})


def _chained(row, state, limit, closes_after):
    """State (shard, open total, groups closed) after a chunk or block, given that before it."""
    shard, total, group = state
    if row["first_shard"] != shard:
        total, group = 0, 0
    if row["single"]:
        total, closed = carry_over(row, total, limit, closes_after)
        return row["last_shard"], total, group + closed
    return row["last_shard"], row["last_exit"], row["last_closes"]


def _followed(table, row, limit, closes_after):
    """Transition of a run followed by another run of the same shard."""
    after = [carry_over(row, e, limit, closes_after) for e in table["exits"]]
    out = {"sums": list(table["sums"]), "exits": [e for e, _ in after],
           "closes": [c + more for c, (_, more) in zip(table["closes"], after, strict=True)],
           "total": table["total"] + row["total"]}
    if table["total"] <= limit:  # an entry may still pass the first run without a cut
        out["sums"] += [table["total"] + s for s in row["sums"]]
        out["exits"] += row["exits"]
        out["closes"] += row["closes"]
    return out


def block_summary(rows, limit, closes_after):
    """One summary of a bounded block of chunk summaries, of the same form as theirs."""
    first, state, block = None, (None, 0, 0), None
    for row in _one_by_one(rows.sort_by("_chunk")):
        if first is None:
            first, block = row, row["_block"]
            run = row
        elif run is not None and row["single"] and row["first_shard"] == run["last_shard"] and run["single"]:
            run = {**run, **_followed(run, row, limit, closes_after)}
        else:
            run = None
        state = _chained(row, state, limit, closes_after)
    whole = run is not None and run["single"]
    table = run if whole else first
    row = {
        "_block": block, "first_shard": first["first_shard"], "single": whole,
        **{k: table[k] for k in ("sums", "exits", "closes", "total")}, "last_shard": state[0],
        "last_exit": state[1], "last_closes": state[2],
    }
    longs = pa.list_(pa.int64())
    types = {"first_shard": pa.string(), "last_shard": pa.string(), "single": pa.bool_(),
             "sums": longs, "exits": longs, "closes": longs}
    return pa.table({k: pa.array([v], types.get(k, pa.int64())) for k, v in row.items()})


def _one_by_one(table):
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def chain_summaries(batch, state, limit, closes_after, number):
    """Entry state of each summary, read one by one in order; also the state after them."""
    state = state or (None, 0, 0)
    entries = {number: [], "entry_shard": [], "entry_total": [], "entry_group": []}
    for row in _one_by_one(pa.Table.from_batches([batch])):
        total, group = state[1:] if row["first_shard"] == state[0] else (0, 0)
        for name, value in zip(entries, (row[number], row["first_shard"], total, group), strict=True):
            entries[name].append(value)
        state = _chained(row, state, limit, closes_after)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    arrays = [pa.array(v, t) for v, t in zip(entries.values(), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(entries)), state


def chain_block(rows, limit, closes_after):
    """Entry states of the chunks of one block, given the block's own entry state."""
    rows = rows.sort_by("_chunk")
    start = (rows["entry_shard"][0].as_py(), rows["entry_total"][0].as_py(), rows["entry_group"][0].as_py())
    state, out = start, []
    for batch in rows.drop_columns(["entry_shard", "entry_total", "entry_group"]).to_batches():
        entries, state = chain_summaries(batch, state, limit, closes_after, "_chunk")
        out.append(entries)
    return pa.Table.from_batches(out)


def assign_groups(rows, limit, closes_after, name):
    """Append the group number to a chunk's rows and drop the helper columns."""
    rows, weights, bounds = _ordered(rows)
    total, group = rows["entry_total"][0].as_py(), rows["entry_group"][0].as_py()
    numbered = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        numbered.append(group_run(weights[start:end], total, group, limit, closes_after))
        total, group = 0, 0
    kept = rows.drop_columns(["_shard", "_row", "_chunk", "_weight",
                              "entry_shard", "entry_total", "entry_group"])
    return kept.append_column(name, pa.array(np.concatenate(numbered), pa.int64()))


def _ordered(rows):
    rows = rows.sort_by("_row")
    codes = rows["_shard"].combine_chunks().dictionary_encode().indices.to_numpy()
    change = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    bounds = [0, *change.tolist(), len(codes)]
    return rows, rows["_weight"].to_numpy(), bounds


# --- best-fit decreasing -----------------------------------------------------------------


def best_fit(lengths, capacity):
    """Bins of items given longest first: the fullest bin with room, lowest number on ties."""
    levels: list[tuple[int, int]] = []
    bins, slots, counts = [], [], []
    for size in lengths:
        at = bisect_right(levels, (capacity - size, 1)) - 1
        if at >= 0:
            fill, neg = levels.pop(at)
            number = -neg
        else:
            fill, number = 0, len(counts)
            counts.append(0)
        insort(levels, (fill + size, -number))
        bins.append(number)
        slots.append(counts[number])
        counts[number] += 1
    return bins, slots


def pack_window(rows, order, capacity):
    """Bin and slot of every unit of one window; ties in length keep the units' order."""
    rows = rows.sort_by([("len", "descending"), *[(c, "ascending") for c in order]])
    bins, slots = best_fit(rows["len"].to_pylist(), capacity)
    return (rows.append_column("bin", pa.array(bins, pa.int32()))
            .append_column("slot", pa.array(slots, pa.int32())))


def cut_units(ids, seq_len, low):
    """Packing units of one row: whole up to ``seq_len``, else blocks, a last one below ``low`` left out."""
    if len(ids) <= seq_len:
        return [list(ids)]
    blocks = [list(ids[at:at + seq_len]) for at in range(0, len(ids), seq_len)]
    return blocks if len(blocks[-1]) >= low else blocks[:-1]


def window_bins(units, capacity, low):
    """(ids, unit lengths) of each bin of one window, its units in order of arrival."""
    fitting = sorted((u for u in units if low <= len(u) <= capacity), key=len, reverse=True)
    bins, _ = best_fit([len(u) for u in fitting], capacity)
    out = [([], []) for _ in range(max(bins, default=-1) + 1)]
    for unit, number in zip(fitting, bins, strict=True):
        out[number][0].extend(unit)
        out[number][1].append(len(unit))
    return out


def bins_of(units, capacity, low):
    """``window_bins`` of each list<list<int32>> of an Arrow array."""
    kind = pa.struct([("bin", pa.int32()), ("input_ids", pa.list_(pa.int32())), ("_lens", pa.list_(pa.int32()))])
    rows = [[{"bin": k, "input_ids": ids, "_lens": lens} for k, (ids, lens) in enumerate(window_bins(window, capacity, low))]
            for window in units.to_pylist()]
    return pa.array(rows, pa.list_(kind))


# --- merges ------------------------------------------------------------------------------


def merge_long(values, lefts, rights, ranks, names):
    """The merged symbols of long pieces, lowest rank first and leftmost among equals."""
    table = dict(zip(zip(lefts.to_pylist(), rights.to_pylist(), strict=True), ranks.to_pylist(), strict=True))
    return [None if v is None else _merge([names[b] for b in v.encode()], table) for v in values.to_pylist()]


def _merge(symbols, table):
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    queue = []

    def offer(i):
        if i >= 0 and after[i] < len(symbols):
            pair = (symbols[i], symbols[after[i]])
            if pair in table:
                heapq.heappush(queue, (table[pair], i, pair))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i]
        if symbols[i] is None or j >= len(symbols) or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i], symbols[j] = pair[0] + pair[1], None
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s is not None]


# --- JSON spelling -----------------------------------------------------------------------


def dump_value(text, ensure_ascii, indent):
    """A JSON text spelled the way ``json.dumps`` does; None if it is not JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=ensure_ascii, indent=indent)
    except ValueError:
        return None


def dump_list(text, ensure_ascii, indent=None):
    """The items of a JSON list, each spelled the way ``json.dumps`` does; None if not a list."""
    if text is None:
        return None
    try:
        items = json.loads(text)
    except ValueError:
        return None
    if not isinstance(items, list):
        return None
    return [json.dumps(item, ensure_ascii=ensure_ascii, indent=indent) for item in items]


def argument_block(text, ensure_ascii):
    """Parameter tags of one call's JSON arguments; None if they are not an object."""
    if text is None:
        return ""
    try:
        arguments = json.loads(text)
    except ValueError:
        return None
    if not isinstance(arguments, dict):
        return None
    out = []
    for name, value in arguments.items():
        nested = isinstance(value, (dict, list))
        shown = json.dumps(value, ensure_ascii=ensure_ascii) if nested else str(value)
        out.append(f"<parameter={name}>\n{shown}\n</parameter>\n")
    return "".join(out)


def same_json(left, right):
    """Equality of two JSON texts by value; None when either is absent."""
    if left is None or right is None:
        return None
    try:
        return json.loads(left) == json.loads(right)
    except ValueError:
        return False
