"""State handles in memory, to run processors without a stream: state outlives a batch, not the processor."""

import pandas as pd


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None


class Items:
    def __init__(self):
        self.items = []

    def exists(self):
        return bool(self.items)

    def get(self):
        return iter(list(self.items))

    def put(self, items):
        self.items = [tuple(x) for x in items]

    def appendList(self, items):
        self.items += [tuple(x) for x in items]

    def clear(self):
        self.items = []


class Map:
    def __init__(self):
        self.map = {}

    def containsKey(self, key):
        return tuple(key) in self.map

    def getValue(self, key):
        return self.map.get(tuple(key))

    def updateValue(self, key, value):
        self.map[tuple(key)] = tuple(value)

    def removeKey(self, key):
        self.map.pop(tuple(key), None)

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))

    def clear(self):
        self.map = {}


class Handle:
    def getValueState(self, *args):
        return Value()

    def getListState(self, *args):
        return Items()

    def getMapState(self, *args):
        return Map()


def run(make, rows, columns, key, cuts):
    """Rows (of one grouping key) through a new processor, in batches that end at the cuts."""
    processor = make()
    processor.init(Handle())
    out, a = [], 0
    for b in [*cuts, len(rows)]:
        if b > a:
            for frame in processor.handleInputRows((key,), iter([pd.DataFrame(rows[a:b], columns=columns)]), None):
                out += list(frame.itertuples(index=False, name=None))
        a = b
    return out
