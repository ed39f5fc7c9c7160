"""Small hand-made tables for golden cases."""

from riskloom.schemas import TXN_SCHEMA


def txn_row(event_id, step=1, kind="TRANSFER", amount=10.0, orig="A", dest="B", **more):
    row = {
        "event_id": event_id,
        "step": step,
        "type": kind,
        "amount": amount,
        "nameOrig": orig,
        "oldbalanceOrg": 0.0,
        "newbalanceOrig": 0.0,
        "nameDest": dest,
        "oldbalanceDest": 0.0,
        "newbalanceDest": 0.0,
        "isFraud": 0,
        "isFlaggedFraud": 0,
    }
    row.update(more)
    return tuple(row[n] for n in TXN_SCHEMA.names)


def txns(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def by_event(df, *columns):
    return {r["event_id"]: tuple(r[c] for c in columns) for r in df.collect()}


class Simulation:
    """One event at a time, one counter per (account, step) for both roles."""

    def __init__(self):
        self.seen = {}

    def add(self, step, orig, dest, cents):
        sender = self.seen.get((orig, step), (0, 0))
        receiver = self.seen.get((dest, step), (0, 0))
        for account in (orig, dest):
            n, c = self.seen.get((account, step), (0, 0))
            self.seen[(account, step)] = (n + 1, c + cents)
        return sender[0], sender[1] / 100, receiver[0]
