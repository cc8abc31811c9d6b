"""Clients that answer searches and paged catalogs from stored rows, for replays without a network."""

from __future__ import annotations


def search(query: str, parameters: dict) -> tuple[int, list[dict]]:
    """The stored results of a query, 404 for one that was never asked. ``parameters['corpus']``: query -> results."""
    found = parameters["corpus"].get(query)
    return (404, []) if found is None else (200, found)


def count_pages(address: str) -> tuple[int, list[dict], str | None]:
    """Rows of an address ``name:page:pages:size``: ``size`` numbers a page, and the address of the next page; 404 beyond the pages."""
    name, page, pages, size = address.rsplit(":", 3)
    k, last, n = int(page), int(pages), int(size)
    if k >= last:
        return 404, [], None
    rows = [{"name": name, "n": k * n + i} for i in range(n)]
    return 200, rows, f"{name}:{k + 1}:{last}:{n}" if k + 1 < last else None
