"""A small example whose nodes, edges, stripes and scores are known, and plain-Python models."""

START_20 = [10001, 20001, 30001, 50001, 70001, 80001, 100001]
START_21 = [30001, 40001, 80001]
EDGES_20 = {(0, 1): 1, (0, 2): 1, (0, 3): 2, (0, 4): 1, (0, 5): 1, (1, 2): 1, (1, 4): 2, (1, 5): 1, (1, 6): 1, (3, 4): 1}
EDGES_21 = {(0, 2): 2, (1, 2): 1}
CONTACT_SCHEMA = "chromosome_A string, start_A long, end_A long, chromosome_B string, start_B long, end_B long"


def example_contacts():
    """Fifteen contacts, some shifted by a little within their bins."""
    rows, shift = [], 0
    for chromosome, starts, edges in (("chr20", START_20, EDGES_20), ("chr21", START_21, EDGES_21)):
        for (a, b), n in edges.items():
            for _ in range(n):
                shift = (shift + 700) % 1500
                x, y = starts[a] - 1 + shift, starts[b] - 1 + shift
                rows.append((chromosome, x, x + 3000, chromosome, y, y + 3000))
    return rows


def span_model(positions, gap):
    """First position of the cluster of each of the sorted positions."""
    out, first = [], None
    for p in positions:
        if first is None or p - first > gap:
            first = p
        out.append(first)
    return out


def island_model(intervals):
    out, high, n = [], None, -1
    for s, e in sorted(intervals):
        if high is None or s >= high:
            n += 1
        high = e if high is None else max(high, e)
        out.append(((s, e), n))
    return out
