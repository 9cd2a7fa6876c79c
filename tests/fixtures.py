"""Small ontologies as text."""

HEAD = "format-version: 1.2\ndata-version: test/a/b/c/\n"


def stanza(term: str, name: str, *lines: str) -> str:
    return "\n".join(["", "[Term]", f"id: {term}", f"name: {name}", *lines, ""])


HIERARCHICAL = HEAD + stanza("Parental", "All", "comment: none") + stanza("Child1", "Child1", "is_obsolete: true", "is_a: Parental ! All", "replaced_by: Child2") + stanza(
    "Child2", "Child2", 'synonym: "1,6-alpha-mannosyltransferase activity" EXACT []', "alt_id: Child3", "alt_id: Child4", "is_a: Parental ! All") + stanza(
    "Child5", "Child5", 'synonym: "1,6-alpha-mannosyltransferase activity" EXACT []', "is_obsolete: true", "is_a: Parental ! All")
SHORT = HEAD + stanza("root", "All") + stanza("Child1", "Child1", "is_a: root ! All") + stanza("Child2", "Child2", "is_a: root ! All")
BRANCHES = HEAD + stanza("root", "All") + stanza("branchA", "Child1", "is_a: root ! All") + stanza("branchAChild1", "Child2", "alt_id: branchAChild3", "is_a: branchA ! Child1") + stanza(
    "branchAChild2", "Child4", "is_a: branchA ! Child1") + stanza("branchB", "Child5", "is_a: root ! All")
BRANCHES2 = BRANCHES + stanza("branchC", "Child6", "is_a: root ! All")
CIRCULAR = HEAD + stanza("A", "All", "is_a: C") + stanza("B", "B", "is_a: A") + stanza("C", "C", "is_a: B")
ATOMIC = HEAD + stanza("Parental", "All", "comment: none") + stanza("Child1", "Child1") + stanza("Child2", "Child2")
SPARSE = HEAD + stanza("A", "All") + stanza("B", "B", "is_a: A") + stanza("C", "C", "is_a: A") + stanza("D", "Sparsed")
DANGLING = HEAD + stanza("T1", "one", "is_a: T9 ! elsewhere", "alt_id: T2") + stanza("T3", "three", 'is_a: T1 {source="x"} ! one')
CHAIN = HEAD + stanza("top", "top") + stanza("GO:0016772", "x", "is_a: top") + stanza("GO:0016773", "y", "is_a: GO:0016772") + stanza("GO:0004396", "z", "is_a: GO:0016773")
