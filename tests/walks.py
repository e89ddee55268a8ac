"""Sequential restatements the distributed operators are checked against."""

import heapq


def commit_order(commits, parents):
    """commits: {sha: epoch}; parents: {sha: [sha]} → shas, parents first."""
    waiting = {s: {p for p in parents.get(s, ()) if p in commits} for s in commits}
    heap = [(commits[s], s) for s in commits if not waiting[s]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, sha = heapq.heappop(heap)
        out.append(sha)
        for child in commits:
            if sha in waiting[child]:
                waiting[child].remove(sha)
                if not waiting[child]:
                    heapq.heappush(heap, (commits[child], child))
    return out


def lives(events):
    """events: [(position, letter, path, old_path)] in order → {position: first position}."""
    holder, answer = {}, {}
    for position, letter, path, old in events:
        source = old if letter == "R" else path
        life = None if letter == "A" else holder.get(source)
        if life is None:
            life = position
        answer[position] = life
        if letter != "D":
            holder[path] = life
    return answer


def definition_events(versions, definitions):
    """versions: [(sha, state)] of one life; definitions: {sha: [(kind, name, fingerprint)]}.

    Returns ({(kind, name, occurrence, change, sha, previous, blind)}, {slot: unresolved shas}).
    """

    def slots(sha):
        counted, found = {}, {}
        for kind, name, fingerprint in definitions.get(sha, []):
            n = counted.get((kind, name), 0)
            counted[(kind, name)] = n + 1
            found[(kind, name, n)] = fingerprint
        return found

    events, last, before, previous, blind = set(), {}, {}, None, []
    ever = False
    for sha, state in versions:
        if state not in ("read", "file_end"):
            blind.append(sha)
            continue
        now = slots(sha) if state == "read" else {}
        for slot in now.keys() | before.keys():
            if slot not in before:
                change = "created"
            elif slot not in now:
                change = "deleted"
            elif now[slot] != before[slot]:
                change = "modified"
            else:
                continue
            events.add((*slot, change, sha, previous, len(blind)))
            last[slot] = change
        before, blind, ever = now, [], True
        if state == "read":
            previous = sha
    tail = {slot: len(blind) for slot, change in last.items() if change != "deleted" and blind and ever}
    return events, tail
