"""What crosses from one layout to the next: values, not the frames they were taken from."""

from barloom.functions import cs, ts
from barloom.functions.expr import close, high, low, open_, volume
from barloom.plans import panel
from barloom.plans.panel import Panel
from tests.conftest import same


def test_frames_and_spent_inputs_do_not_cross_exchanges(spark, bars, monkeypatch):
    entered, run_stage = [], panel._Evaluation._run_stage
    monkeypatch.setattr(panel._Evaluation, "_run_stage", lambda self, df, s, nodes: (entered.append((s, df.dtypes)), run_stage(self, df, s, nodes))[1])
    exprs = {
        "ranked": cs.cs_rank(ts.ts_rank(close, 7)) * ts.ts_rank(volume, 5),
        "again": ts.ts_mean(cs.cs_rank(ts.ts_decay_linear(close - open_, 6)), 3) + ts.ts_argmax(high, 4),
        "spread": cs.cs_rank(close - open_) + (high - low) / (close + open_),
    }
    got = Panel(bars).select(exprs).cache()
    later = [dtypes for s, dtypes in entered if s > 0]
    assert len(later) == 2 and [d for dtypes in later for d in dtypes if d[1].startswith("array")] == []
    # two ranks of frames, a decay, an argmax, a difference of prices and a quotient, beside the keys;
    # then two finished values, the rank of the decay and the argmax
    assert [len(dtypes) for dtypes in later] == [2 + 6, 2 + 4]
    split = Panel(bars, max_group_rows=40).select(exprs)
    same(got, split)
    alone = [Panel(bars).select({name: e}) for name, e in exprs.items()]
    for df in alone:
        same(got.select(*df.columns), df)
