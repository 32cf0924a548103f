"""Small snapshots written as JSON."""

import json
from pathlib import Path


def deck(deck_id, pilot="p1", title="1st Ann B - Storm - E1", event="E1", created="2024-06-01T10:00:00+00:00", placement=None, norm=None, **more):
    return {
        "deckId": deck_id, "name": title, "deckName": "Storm", "pilot": pilot, "event": event, "eventId": None, "eventType": "Tournament", "placement": placement, "placementNorm": norm, "eventSize": 32,
        "createdAt": created, "colour": "colour:UB", "macro": "macro:combo", "engineTags": ["engine:storm"], "engineTagLabels": {"engine:storm": "Storm"}, "primaryTag": "engine:storm", "primaryTagWeights": {"engine:storm": 90},
    } | more


def card(canon, kind="Instants", points=0, companion=0, cost="{U}"):
    return {"canon": canon, "name": canon.title(), "type": kind, "manaCost": cost, "manaValue": 1.0, "reserved": False, "priceUsd": None, "points": points, "pointsCompanion": companion}


def write(root, stamp, decks, cards, lists):
    folder = Path(root) / stamp
    folder.mkdir(parents=True)
    (folder / "decks.json").write_text(json.dumps(decks))
    (folder / "cards_index.json").write_text(json.dumps({"v": 1, "cards": cards, "decks": lists}))
    return str(folder)
