"""The order of a document's pages under edits: a linked list with an index of page ids, so that an edit takes a few steps and not a copy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class PageOrder:
    """Ordered page ids. An id that stands more than once is deleted whole, and moved or used as an anchor where it stands first."""

    def __init__(self, pages: Iterable[str]) -> None:
        # node 0 is both ends; nodes are numbered as they come and never used again
        self.after, self.before, self.page = [0], [0], [""]
        self.nodes: dict[str, list[int]] = {}
        self.size = 0
        for p in pages:
            self.put(p, 0)

    def __iter__(self) -> Iterator[str]:
        node = self.after[0]
        while node:
            yield self.page[node]
            node = self.after[node]

    def put(self, page: str, anchor: int) -> None:
        """A new node in front of the anchor."""
        node = len(self.page)
        self.page.append(page)
        self.after.append(anchor)
        self.before.append(self.before[anchor])
        self.after[self.before[anchor]] = self.before[anchor] = node
        self.nodes.setdefault(page, []).append(node)
        self.size += 1

    def take(self, node: int) -> None:
        self.after[self.before[node]], self.before[self.after[node]] = self.after[node], self.before[node]
        own = self.nodes[self.page[node]]
        own.remove(node)
        if not own:
            del self.nodes[self.page[node]]
        self.size -= 1

    def first(self, page: str | None) -> int:
        """The node where an id stands first, 0 if nowhere. Only ids that stand more than once need a walk."""
        own = self.nodes.get(page, ())
        if len(own) < 2:
            return own[0] if own else 0
        node = self.after[0]
        while self.page[node] != page:
            node = self.after[node]
        return node

    def delete(self, page: str) -> bool:
        """Whether the id could be deleted: it is there, and not all that is left."""
        own = self.nodes.get(page, ())
        if not own or len(own) == self.size:
            return False
        for node in [*own]:
            self.take(node)
        return True

    def move(self, page: str, before: str | None) -> None:
        """Without an anchor to the end; nothing if the page or the anchor is missing, and a page that stands once is no anchor of its own."""
        node = self.first(page)
        if not node:
            return
        behind = self.after[node]
        self.take(node)
        anchor = self.first(before)
        self.put(page, anchor if anchor or before is None else behind)

    def insert(self, pages: Iterable[str], before: str | None) -> None:
        """In front of the anchor, or at the end if it is missing."""
        anchor = self.first(before)
        for p in pages:
            self.put(p, anchor)

    def edit(self, kind: str, page: str | None, before: str | None, added: list[str] | None) -> bool:
        """Does one edit; whether it is a delete that took effect."""
        if kind == "delete":
            return self.delete(page)
        if kind == "move":
            self.move(page, before)
        elif added is not None:
            self.insert(added, before)
        return False
