"""Score one block of documents against one block of queries of the same tenant.

This is the only imperative step of retrieval. Blocks are bounded Arrow tables
handed over by Spark; what comes back is each query's best ``k`` of the block,
never the block's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DIGITS = 9
#: Stands for a similarity that is not a number; below every score, above "no hit".
UNDEFINED = -1e100
_CELLS_PER_STEP = 4_000_000
#: Candidates are scored exactly once there are so many.
_PAIRS_HELD = 500_000
NO_TIME_LIMIT = np.iinfo(np.int64)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which rows have one (null vectors become zeros)."""
    lists = column.combine_chunks()
    known = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    lengths = pc.unique(pc.list_value_length(lists.drop_null())).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of one table need equal lengths, got {sorted(lengths)}")
    out = np.zeros((len(lists), lengths[0] if lengths else 0))
    values = lists.drop_null().flatten().to_numpy(zero_copy_only=False)
    if out.size:
        out[known] = values.astype(np.float64, copy=False).reshape(-1, out.shape[1])
    return out, known


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    norm[norm == 0] = 1.0
    return norm


def _flat(lists: pa.ChunkedArray, dtype) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _lengths(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


#: Blocks of so many documents per wanted hit are ranked in single precision first.
_SINGLE_DOCS = 100
#: Pairs whose vectors are multiplied in one go.
_PAIRS_PER_STEP = 4096


def _ordinary(m: np.ndarray) -> bool:
    """Whether every row is zero or has a largest value far from where numbers end."""
    if not m.size:
        return False
    largest = np.maximum(m.max(axis=1), -m.min(axis=1))
    return bool(((largest == 0) | ((largest > 1e-60) & (largest < 1e60))).all())


class _Dense:
    """Cosines by matrix product.

    Large blocks are multiplied as unit vectors in single precision, whose error
    is bounded by the dimension; documents that could be among the best are
    multiplied again in double precision.
    """

    descending_id, least = True, -np.inf

    def __init__(self, docs: pa.Table, queries: pa.Table, k: int):
        (self.d, self.d_known), (self.q, self.q_known) = _matrix(docs["dense"]), _matrix(queries["dense"])
        self.dn, self.qn = _unit(self.d), _unit(self.q)
        large = len(self.d) >= _SINGLE_DOCS * k
        #: Whether pairs can be scored one by one.
        self.alone = self.d.shape[1] == self.q.shape[1] and _ordinary(self.d) and _ordinary(self.q)
        self.single, self.d_unit = large and self.alone, None
        self.error = (self.d.shape[1] + 16) * 2.0**-23

    def ranked(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return self.q_known[row] & self.d_known[col]

    def rough(self, a: int, b: int) -> tuple[np.ndarray, float, float]:
        if not (self.d_known.any() and self.q_known[a:b].any()):
            return np.full((b - a, len(self.d)), -np.inf), 0.0, 0.0
        if self.single:
            if self.d_unit is None:
                self.d_unit = np.divide(self.d, self.dn[:, None], dtype=np.float64).astype(np.float32)
            out = (self.q[a:b] / self.qn[a:b, None]).astype(np.float32) @ self.d_unit.T
        else:
            with np.errstate(invalid="ignore", over="ignore"):
                out = self.q[a:b] @ self.d.T
                out /= self.qn[a:b, None]
                out /= self.dn[None, :]
            out[np.isnan(out)] = UNDEFINED
        out[~self.q_known[a:b]] = -np.inf
        out[:, ~self.d_known] = -np.inf
        return out, 0.0, self.error if self.single else 0.0

    def exact(self, row: np.ndarray, col: np.ndarray, rough: np.ndarray) -> np.ndarray:
        return self.pairs(row, col) if self.single else rough

    def pairs(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for i in range(0, len(row), _PAIRS_PER_STEP):
            q, d = row[i : i + _PAIRS_PER_STEP], col[i : i + _PAIRS_PER_STEP]
            out[i : i + len(q)] = np.einsum("ij,ij->i", self.q[q], self.d[d]) / self.qn[q] / self.dn[d]
        return out


#: A term is a column of a matrix product if so large a part of all pairs shares it, up to so many terms.
_SHARED, _COLUMNS = 0.003, 1024
#: Weights that single precision holds with room to spare, also when multiplied.
_SMALL, _LARGE = 1e-12, 1e12
_ENTRIES_PER_STEP = 1_000_000
#: Laying out a row's weights takes as long as reading so many entries.
_LAYING_OUT = 3_000


#: Places of the table that tells terms apart by their lowest bits; terms that share a place are searched.
_PLACES = 1 << 22


def _numbered(asked: np.ndarray, given: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms are asked for, and the number among them of every asked and given term (-1: not asked for)."""
    terms, place = np.unique(asked, return_inverse=True)
    if not len(terms):
        return 0, place, np.full(len(given), -1)
    table = np.full(_PLACES, -1, np.int32)
    table[terms & (_PLACES - 1)] = np.arange(len(terms))
    at = table[given & (_PLACES - 1)]
    other = np.flatnonzero((terms[at] != given) & (at >= 0))
    near = np.searchsorted(terms, given[other])
    near[near == len(terms)] = 0
    at[other] = np.where(terms[near] == given[other], near, -1)
    return len(terms), place, at


def _order(numbers: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers from 0 below ``n``: they are sorted together with their places."""
    bits = len(numbers).bit_length()
    if n << bits > 1 << 62:
        return np.argsort(numbers, kind="stable")
    key = numbers.astype(np.int64)
    key <<= bits
    key |= np.arange(len(key))
    key.sort()
    key &= (1 << bits) - 1
    return key


def _ascending(terms: np.ndarray, ends: np.ndarray) -> bool:
    """Whether the terms of every row ascend, each once."""
    later = np.ones(len(terms) + 1, bool)
    later[1:-1] = terms[1:] > terms[:-1]
    later[np.r_[0, ends]] = True
    return bool(later.all())


class _Sparse:
    """Dot products over a term-ordered index of the block's entries.

    Terms that many pairs share are multiplied as matrices in single precision,
    the others are added entry by entry. With positive weights the relative error
    of such a sum is bounded by its length, so no document that could be among
    the best is missed; those left are added up again in double precision, in the
    order of their terms. Other weights are added in double precision at once.
    """

    descending_id = False

    def __init__(self, docs: pa.Table, queries: pa.Table, k: int):
        self.n = docs.num_rows
        self.q_end = np.cumsum(_lengths(queries["indices"]))
        idx = _flat(docs["indices"], np.int64)
        n_terms, self.q_term, at = _numbered(_flat(queries["indices"], np.int64), idx)
        self.q_w = _flat(queries["values"], np.float64)
        used = np.flatnonzero(at >= 0)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), _lengths(docs["indices"]))[used]
        self.d_term, self.d_w = at[used], _flat(docs["values"], np.float64)[used]
        self.d_end = np.cumsum(np.bincount(doc, minlength=self.n))
        size = np.bincount(self.d_term, minlength=n_terms)
        sides = (self.q_term, self.q_w, self.q_end), (self.d_term, self.d_w, self.d_end)
        self.least = -np.inf
        self.plain = self.alone = all(_ascending(t, end) and bool(((w >= _SMALL) & (w <= _LARGE)).all()) for t, w, end in sides)
        term, w = self.d_term, self.d_w
        if self.plain:
            self.least = 0.0
            self._split(size, doc)
            listed = np.flatnonzero(self.light[term])
            doc, term, w = doc[listed], term[listed], w[listed].astype(np.float32)
            size = size * self.light
        order = _order(term, n_terms)
        self.doc, self.w = doc[order], w[order]
        self.start = np.r_[0, np.cumsum(size)]
        self.weights = np.zeros(n_terms)

    def _split(self, size: np.ndarray, doc: np.ndarray) -> None:
        """Take the terms that many pairs share out of the lists, as matrices."""
        rows, n_terms = len(self.q_end), len(size)
        shared = size * np.bincount(self.q_term, minlength=n_terms)
        heavy = np.flatnonzero(shared > _SHARED * self.n * rows)
        heavy = heavy[np.argsort(-shared[heavy], kind="stable")[:_COLUMNS]]
        column = np.full(n_terms, -1, np.int32)
        column[heavy] = np.arange(len(heavy))
        self.d_heavy = np.zeros((self.n, len(heavy)), np.float32)
        of = column[self.d_term]
        kept = np.flatnonzero(of >= 0)
        self.d_heavy[doc[kept], of[kept]] = self.d_w[kept]
        self.q_heavy = np.zeros((rows, len(heavy)), np.float32)
        of = column[self.q_term]
        kept = np.flatnonzero(of >= 0)
        row = np.repeat(np.arange(rows), np.diff(np.r_[0, self.q_end]))
        self.q_heavy[row[kept], of[kept]] = self.q_w[kept]
        self.light = column < 0
        longest = min(int(np.diff(np.r_[0, end]).max(initial=0)) for end in (self.q_end, self.d_end))
        self.error = (longest + 16) * 2.0**-23

    def ranked(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        # pairs that share nothing add up to zero, which ``least`` drops
        return np.ones(len(row), bool)

    def _entries(self, a: int, b: int, most: int = 2**62):
        """Cell and product of every listed entry of the queries' terms, ``most`` or a term's at a time."""
        low, high = self.q_end[a - 1] if a else 0, self.q_end[b - 1]
        term, weight = self.q_term[low:high], self.q_w[low:high].astype(self.w.dtype)
        row = np.repeat(np.arange(b - a), np.diff(np.r_[low, self.q_end[a:b]]))
        size = self.start[term + 1] - self.start[term]
        some = np.flatnonzero(size)
        term, weight, row, size = term[some], weight[some], row[some], size[some]
        edges = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(term)]):
            part = size[i:j]
            begin = np.cumsum(part) - part
            entry = np.arange(int(part.sum()))
            entry += np.repeat(self.start[term[i:j]] - begin, part)
            cell = np.repeat(row[i:j] * self.n, part)
            cell += self.doc[entry]
            product = np.repeat(weight[i:j], part)
            product *= self.w[entry]
            yield cell, product

    def rough(self, a: int, b: int) -> tuple[np.ndarray, float, float]:
        if self.plain:
            out = self.q_heavy[a:b] @ self.d_heavy.T
            for cell, product in self._entries(a, b, _ENTRIES_PER_STEP):
                np.add.at(out.reshape(-1), cell, product)
            np.copyto(out, -np.inf, where=out == 0)  # weights are positive: nothing shared
            return out, self.error, 0.0
        out = np.full((b - a) * self.n, -np.inf)
        cell, product = next(self._entries(a, b))
        if len(cell):
            score = np.bincount(cell, product, len(out))
            cell = np.unique(cell)
            found = score[cell]
            out[cell] = np.where(np.isnan(found), UNDEFINED, found)
        return out.reshape(b - a, self.n), 0.0, 0.0

    def exact(self, row: np.ndarray, col: np.ndarray, rough: np.ndarray) -> np.ndarray:
        return self.pairs(row, col) if self.plain else rough

    def pairs(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Scores of single pairs, added up in the order of the terms.

        The weights of one side are laid out by term, those of its partners are
        picked from there: query by query, or document by document where that
        reads less, as the best documents are often long.
        """
        sides = [(row, self.q_term, self.q_w, self.q_end), (col, self.d_term, self.d_w, self.d_end)]
        size = [np.diff(np.r_[0, end])[place] for place, _, _, end in sides]
        laid = [len(np.unique(place)) * _LAYING_OUT for place, *_ in sides]
        if size[0].sum() + laid[1] < size[1].sum() + laid[0]:
            sides, size = sides[::-1], size[::-1]
        (own, own_term, own_w, own_end), (other, term, w, end) = sides
        order = np.argsort(own, kind="stable")
        own, other, size = own[order], other[order], size[1][order]
        step = np.cumsum(size) // _ENTRIES_PER_STEP
        edges = np.flatnonzero((own[1:] != own[:-1]) | (step[1:] != step[:-1])) + 1
        out = np.empty(len(own))
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(own)] if len(own) else []):
            mine = slice(own_end[own[i] - 1] if own[i] else 0, own_end[own[i]])
            self.weights[own_term[mine]] = own_w[mine]
            part = size[i:j]
            entry = np.arange(int(part.sum())) + np.repeat(end[other[i:j]] - np.cumsum(part), part)
            # a term that is not shared adds zero
            product = self.weights[term[entry]] * w[entry]
            out[order[i:j]] = np.bincount(np.repeat(np.arange(j - i), part), product, j - i)
            self.weights[own_term[mine]] = 0.0
        return out


class _Codes:
    """Sums of table entries: a document's codes pick from the query's table, part by part."""

    descending_id, least, alone = True, -np.inf, False

    def __init__(self, docs: pa.Table, queries: pa.Table, k: int):
        codes = docs["codes"].combine_chunks()
        self.known = pc.is_valid(codes).to_numpy(zero_copy_only=False)
        held = codes.drop_null().to_pylist()
        self.parts = len(held[0]) if held else 1
        self.d = np.zeros((len(codes), self.parts), np.int64)
        self.d[self.known] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, self.parts)
        self.q, self.q_known = _matrix(queries["codes"])
        self.d += np.arange(self.parts) * (self.q.shape[1] // self.parts)

    def rough(self, a: int, b: int) -> tuple[np.ndarray, float, float]:
        out = np.zeros((b - a, len(self.d)))
        if self.q.shape[1]:
            for part in range(self.parts):
                out += self.q[a:b, self.d[:, part]]
        out[~self.q_known[a:b]] = -np.inf
        out[:, ~self.known] = -np.inf
        return out, 0.0, 0.0

    def exact(self, row: np.ndarray, col: np.ndarray, rough: np.ndarray) -> np.ndarray:
        return rough


_SCORERS = {"dense": _Dense, "sparse": _Sparse, "codes": _Codes}


class _Filters:
    """Per-query category and time conditions as a mask over the block."""

    def __init__(self, docs: pa.Table, queries: pa.Table):
        if "category_filter" not in queries.column_names:
            self.any_category = self.any_time = False
            return
        wanted = queries["category_filter"]
        self.any_category = wanted.null_count < len(wanted)
        if self.any_category:
            values = pc.unique(wanted.drop_null())
            self.d_cat = pc.fill_null(pc.index_in(docs["category"], values), -1).to_numpy()
            self.q_cat = pc.fill_null(pc.index_in(wanted, values), -2).to_numpy()
        lo, hi = queries["created_after"], queries["created_before"]
        self.any_time = min(lo.null_count, hi.null_count) < len(lo)
        if self.any_time:
            self.lo = pc.fill_null(lo, NO_TIME_LIMIT.min).to_numpy()
            self.hi = pc.fill_null(hi, NO_TIME_LIMIT.max).to_numpy()
            self.timed = pc.or_(pc.is_valid(lo), pc.is_valid(hi)).to_numpy()
            self.unknown = pc.is_null(docs["created_at"]).to_numpy()
            self.at = pc.fill_null(docs["created_at"], 0).to_numpy()

    def hide(self, scores: np.ndarray, a: int, b: int) -> None:
        if self.any_category:
            q = self.q_cat[a:b, None]
            scores[(q != -2) & (q != self.d_cat[None, :])] = -np.inf
        if self.any_time:
            outside = (self.at < self.lo[a:b, None]) | (self.at > self.hi[a:b, None])
            outside |= self.timed[a:b, None] & self.unknown[None, :]
            scores[outside] = -np.inf


#: Queries of at most so many categories are scored apart.
_CATEGORIES = 16
#: Time limits that leave so small a part of all pairs are applied before scoring.
_NARROW = 1 / 32


def by_conditions(queries: pa.Table) -> list[pa.Table]:
    """The queries in groups: of a category, and of a time range or none, where the categories are few."""
    if "category_filter" not in queries.column_names or not queries.num_rows:
        return [queries]
    category = queries["category_filter"].combine_chunks().dictionary_encode()
    if len(category.dictionary) > _CATEGORIES:
        return [queries]
    timed = pc.and_(pc.is_valid(queries["created_after"]), pc.is_valid(queries["created_before"])).to_numpy()
    group = 2 * pc.fill_null(category.indices, -1).to_numpy(zero_copy_only=False) + timed
    values = np.unique(group)
    return [queries.filter(pa.array(group == value)) for value in values] if len(values) > 1 else [queries]


def _first_k(row, doc, score, k: int, descending_id: bool):
    """The first k of each row by score; ties are broken by id."""
    order = np.lexsort((-doc if descending_id else doc, -score, row))
    row, doc, score = row[order], doc[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], doc[top], score[top]


class BestOf:
    """The best ``k`` documents per query and mode over all blocks seen so far.

    A document without a vector is not ranked, nor is one that a filter hides.
    A similarity that is not a number ranks after every other and is reported
    as null, so a broken vector costs nothing but its own place.
    """

    def __init__(self, queries: pa.Table, modes, k: int):
        self.queries, self.modes, self.k = queries, modes, k
        self.ids = queries["query_id"].to_numpy()
        self.category = self.limits = None
        if "category_filter" in queries.column_names and queries.num_rows:
            category, limits = queries["category_filter"], [queries[x] for x in ("created_after", "created_before")]
            if not category.null_count and len(pc.unique(category)) == 1:
                self.category = category[0]
            if not any(x.null_count for x in limits):
                self.limits = [x.to_numpy() for x in limits]
        none = np.empty(0, np.int64)
        self.held = {mode: (none, none, np.empty(0)) for mode in modes}

    def _candidates(
        self, scores: np.ndarray, relative: float, absolute: float, bound: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all scores that may be among the best k; ``bound`` is the k-th held."""
        if scores.shape[1] > self.k and not np.isfinite(bound).all():
            bound = np.maximum(bound, np.partition(scores, -self.k, axis=1)[:, -self.k])
        # Rounding moves a score, and the bound, by half a digit each.
        known = np.isfinite(bound)
        error = relative * np.abs(np.where(known, bound, 0)) + absolute
        lowest = np.where(known, bound - 2 * error - 2 * 10.0**-SCORE_DIGITS, bound)
        if scores.dtype == np.float32:
            lowest = np.nextafter(lowest.astype(np.float32), np.float32(-np.inf))
        keep = scores >= lowest[:, None]
        if not np.isfinite(lowest).all():
            keep &= scores > -np.inf
        return np.divmod(np.flatnonzero(keep), scores.shape[1])

    def _in_time(self, docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        """The documents by time and each query's first and number of them, if all have limits and these leave few."""
        if self.limits is None:
            return None
        order = pc.sort_indices(docs, [("created_at", "ascending")])
        order = order.slice(0, docs.num_rows - docs["created_at"].null_count)
        at = docs["created_at"].take(order).to_numpy()
        first, after = np.searchsorted(at, self.limits[0]), np.searchsorted(at, self.limits[1], "right")
        number = np.maximum(after - first, 0)
        if number.sum() > _NARROW * len(self.ids) * len(at):
            return None
        some = number > 0
        edges = np.bincount(first[some], minlength=len(at) + 1) - np.bincount(after[some], minlength=len(at) + 1)
        asked = np.cumsum(edges)[:-1] > 0
        place = np.r_[0, np.cumsum(asked)]
        return docs.take(order.filter(pa.array(asked))), place[first], number

    def _listed(self, scorer, first: np.ndarray, number: np.ndarray):
        """Pairs that the time limits leave, some queries at a time."""
        step = np.cumsum(number) // _PAIRS_HELD
        edges = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
            part = number[a:b]
            row = np.repeat(np.arange(a, b), part)
            col = np.arange(len(row)) + np.repeat(first[a:b] - np.cumsum(part) + part, part)
            ranked = scorer.ranked(row, col)
            yield b, row[ranked], col[ranked], np.zeros(int(ranked.sum()))

    def _matched(self, scorer, docs: pa.Table, bounds: np.ndarray):
        """Pairs that may be among the best, some queries at a time."""
        filters = _Filters(docs, self.queries)
        step = max(1, _CELLS_PER_STEP // docs.num_rows)
        for a in range(0, len(self.ids), step):
            b = min(a + step, len(self.ids))
            scores, *error = scorer.rough(a, b)
            filters.hide(scores, a, b)
            row, col = self._candidates(scores, *error, bounds[a:b])
            yield b, row + a, col, scores[row, col]

    def add(self, docs: pa.Table) -> None:
        if self.category is not None:
            docs = docs.filter(pc.equal(docs["category"], self.category))
        if not docs.num_rows or not len(self.ids):
            return
        k, in_time = self.k, self._in_time(docs)
        for mode in self.modes:
            used = docs if in_time is None else in_time[0]
            scorer = _SCORERS[mode](used, self.queries, k)
            listed = in_time is not None and scorer.alone
            if in_time is not None and not listed:
                used, scorer = docs, _SCORERS[mode](docs, self.queries, k)
            ids, held = used["id"].to_numpy(), self.held[mode]
            end = np.cumsum(np.bincount(held[0], minlength=len(self.ids)))
            full = np.diff(np.r_[0, end]) == k
            bounds = np.full(len(self.ids), -np.inf)
            bounds[full] = held[2][end[full] - 1]
            found = self._listed(scorer, *in_time[1:]) if listed else self._matched(scorer, used, bounds)
            parts, begin, pairs, size = [], 0, [], 0
            for b, *pair in found:
                pairs.append(pair)
                size += len(pair[0])
                if size < _PAIRS_HELD and b < len(self.ids):
                    continue
                row, col, score = (np.concatenate(x) for x in zip(*pairs))
                score = scorer.pairs(row, col) if listed else scorer.exact(row, col, score)
                kept = ~(score <= scorer.least)
                row, col, score = row[kept], col[kept], np.round(score[kept], SCORE_DIGITS) + 0.0
                mine = slice(end[begin - 1] if begin else 0, end[b - 1])
                both = zip((x[mine] for x in held), (row, ids[col], score))
                parts.append(_first_k(*(np.concatenate(x) for x in both), k, scorer.descending_id))
                begin, pairs, size = b, [], 0
            self.held[mode] = tuple(np.concatenate(x) for x in zip(*parts))

    def tables(self) -> Iterator[pa.Table]:
        for mode, (row, doc, score) in self.held.items():
            yield pa.table(
                {
                    "mode": pa.array([mode] * len(row), pa.string()),
                    "query_id": pa.array(self.ids[row], pa.int64()),
                    "id": pa.array(doc, pa.int64()),
                    "score": pa.array(score, mask=score < UNDEFINED / 2),
                }
            )
