"""Stand-ins for what is outside; workers import them, so that they can be sent there."""

import datetime as dt
import os
import uuid


class Client:
    """Answers for every day of a span; notes each call in a folder; fails as told."""

    def __init__(self, folder, fails=(), broken=()):
        self.folder, self.fails, self.broken = str(folder), set(fails), set(broken)

    def __call__(self, token, first, last):
        seen = [f for f in os.listdir(self.folder) if f.startswith(f"{token}.{first}.")]
        open(os.path.join(self.folder, f"{token}.{first}.{uuid.uuid4().hex}"), "w").close()
        if token in self.broken or (token in self.fails and not seen):
            raise OSError("busy")
        if token == 5:
            return []
        return [(dt.datetime.combine(first, dt.time()) + dt.timedelta(days=k), 1.0, 1.0, 1.0, float(k), 7) for k in range(0, (last - first).days + 1, 100)]


class TickFile:
    """A feed over a CSV file of ``token,seconds,price`` lines."""

    def __init__(self, path):
        self.path = str(path)

    def _lines(self):
        with open(self.path) as f:
            return f.read().splitlines()

    def end(self):
        return len(self._lines())

    def ticks(self, start, stop, lane, lanes):
        for line in self._lines()[start:stop]:
            token, seconds, price = line.split(",")
            if int(token) % lanes == lane:
                yield int(token), dt.datetime(2024, 1, 1, 4, tzinfo=dt.UTC) + dt.timedelta(seconds=float(seconds)), float(price)
