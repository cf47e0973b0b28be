"""Small match documents written by hand."""

from __future__ import annotations

import json


def ball(batter, bowler, other, bat=0, extras=None, out=()):
    extras = extras or {}
    more = sum(extras.values())
    d = {"batter": batter, "bowler": bowler, "non_striker": other,
         "runs": {"batter": bat, "extras": more, "total": bat + more}}
    if extras:
        d["extras"] = extras
    if out:
        d["wickets"] = [{"kind": k, "player_out": p} for k, p in out]
    return d


def innings(team, *overs, **more):
    return {"team": team, "overs": [{"over": i, "deliveries": list(o)} for i, o in enumerate(overs)],
            **more}


def match(*parts, people, teams=("India", "England"), date="2020-05-01", outcome=None, gender="male",
          players=None, **info):
    return {
        "info": {"dates": [date], "gender": gender, "teams": list(teams), "venue": "Eden Gardens, Kolkata",
                 "city": "Kolkata", "season": "2020", "registry": {"people": people},
                 "outcome": outcome or {}, "players": players or {}, **info},
        "innings": list(parts),
    }


def save(folder, **documents):
    folder.mkdir(parents=True, exist_ok=True)
    for name, doc in documents.items():
        text = doc if isinstance(doc, str) else json.dumps(doc)
        (folder / f"{name}.json").write_text(text)
    return str(folder)
