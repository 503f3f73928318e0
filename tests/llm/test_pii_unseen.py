"""Names, streets and sentences that share nothing with the training, the lexicon or the tables."""

import os
import re

import pytest

from spanforge.llm import lexicon, pii, pii_train

NAMES = (
    "Ottilie Vandermeer;Fenella Blackwood;Ignatius Pellworm;Marguerite Delacroix;Tobiah Kestrel;Anselm Grüber;Leocadia Fonseca;Baltasar Quiroga;Ruaridh Macphee;Sholto Dalrymple;Eilidh Urquhart;Zbyszek Trzaskowski;Ottokar Wernicke;Hildburg Zschäpe;Aurelie Thibodeaux;Casimir Przybylski;Evangelos Tsoukalas;Ludmil Zhivkov;Sigvard Almgren;"
    "Jorunn Thorvaldsen;Pelle Nyqvist;Dagny Haugland;Wenceslas Hrabal;Bohumila Štěpánková;Ignác Kertész;Szilvia Pálfi;Tomislava Brkić;Yevhen Rudenko;Rustam Gadzhiev;Nurlan Abdykaparov;Shabnam Tavakoli;Farrokh Daneshvar;Yehudit Ravitz;Amichai Zilberman;Chidiebere Nwachukwu;Omotola Jalade;Kgosi Sebego;Lwazi Ngcobo;Wangari Maathai;"
    "Haruhiko Kuroda;Tsubasa Ozora;Seonhwa Baek;Nguyet Trinh;Srinivasa Ramanujan;Venkatraman Subbulakshmi;Thilakaratne Jayasuriya;Gwendolyn Featherstone;Percival Hawksmoor;Aurélien Coquelin;Fiammetta Brancaleone;Ercole Santangelo;Iolanda Capdevila;Xoán Carballeira;Txomin Etxeberria;Mireia Puigdomènech"
).split(";")
STREETS = (
    "12 Elm Close;7 Abbey Gardens;100 Broadway;Unter den Linden 77;44 Primrose Hill;9 Rosebery Avenue;1600 Amphitheatre Parkway;221B Baker Street;3 Thornbury Mews;58 Whitechapel Road;Kurfürstendamm 211;Zeil 106;Invalidenstraße 43;Am Kupfergraben 6;An der Urania 17;15 rue du Faubourg;8, quai Branly;23 boulevard Haussmann;Calle Fuencarral 88;"
    "Paseo de Gracia, 92;Via Montenapoleone 8;Corso Buenos Aires 33;Rua Garrett 120;Keizersgracht 324;Prinsenlaan 12;Storgatan 19;ul. Marszałkowska 84;17 Old Compton Street;400 W. 42nd Street;5 Horse Guards Parade"
).split(";")
SAID = {
    "person_name": ("Ms {x} is out this week.", "Could {x} confirm the slot?", "We spoke to {x} about the leak.", "{x} never replied", "Bill goes to {x}, not to us", "Le rapport vient de {x}.", "Die Rechnung geht an {x}.", "guest={x}", "{x} has the keys", "Delivered; {x} took it in."),
    "street_address": ("The van stopped at {x}.", "New premises: {x}", "He owns {x} and rents it out.", "Bring it over to {x} tonight.", "dest={x}", "Wir ziehen nach {x} um."),
}
PLAIN = (
    "The Quick Response Team met.;Open Source Software wins.;Visit Golden Gate Park.;Our Premium Plan renews.;Error in Payment Gateway Service.;Black Friday Deals, day 3;Gift Card Balance 20;North Sea Ferry, deck 4;Harvard Business Review 12;Microsoft Azure Cloud;Apollo Landing Module;Quarterly Sales Report;Mount Everest Base Camp;"
    "Room 12 Main Hall;Windows Defender Update;Kubernetes Cluster Autoscaler;Ocean View Hotel;Data Protection Officer;Lost Luggage Desk;Customer Success Manager;Neue Bestellung Nummer 5;Grand Central Station;Kind Regards;User Agent Mozilla Firefox;Order Status Shipped. Thank You;Hudson Valley Farm;Diamond Jubilee Concert;"
    "Take exit D. Turn left.;We sell vitamin K. Ask us.;Rows 12-14-16 are full;Box 3 of 12, 40 x 60 x 80;2024-11-05 08:15:00 ok;build 4.12.2009 passed;Pages 100 to 120"
).split(";")


def _said(kind, things):
    for x in things:
        for c in SAID[kind]:
            yield c.format(x=x), (c.index("{x}"), c.index("{x}") + len(x), kind)


@pytest.mark.parametrize("kind,things,least", [("person_name", NAMES, 0.9), ("street_address", STREETS, 0.9)])
def test_recall_of_whole_spans(kind, things, least):
    all_ = list(_said(kind, things))
    assert sum(span in pii.find(text) for text, span in all_) >= least * len(all_)


def test_precision():
    right = wrong = 0
    for kind, things in (("person_name", NAMES), ("street_address", STREETS)):
        for text, span in _said(kind, things):
            found = pii.find(text)
            right += span in found
            wrong += sum(f != span for f in found)
    wrong += sum(len(pii.find(t)) for t in PLAIN)
    assert wrong <= 0.1 * (right + wrong)
    assert sum(bool(pii.find(t)) for t in PLAIN) <= 0.1 * len(PLAIN)


def test_the_other_half_of_the_lexicon_in_other_sentences():
    carriers = {k: SAID.get(k, ("Note: {x}", "v={x}", "Take {x} down.")) for k in pii.TYPES}
    got = pii_train.evaluate(pii.WEIGHTS, pii_train.Maker(77, 1, carriers, tuple(f"{t.rstrip('.')}." for t in PLAIN)), 1500)
    assert all(r >= 0.9 for _, r in got.values()), got
    # half of all sentences are from PLAIN here, and its few mistaken ones weigh as much as a quarter of the names
    assert all(p >= (0.7 if k == "person_name" else 0.9) for k, (p, _) in got.items()), got


def test_nothing_is_shared():
    lists = lexicon.GIVEN | lexicon.SURNAME
    assert not [n for n in NAMES if any(w.lower() in lists for w in n.split())]
    trained = " ".join((*pii_train.PLAIN, *(c for cs in pii_train.CARRIERS.values() for c in cs)))
    assert not [c for cs in SAID.values() for c in cs if any(len(part.strip()) > 5 and part in trained for part in c.split("{x}"))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_training_sentences_are_not_those_of_the_tables():
    import duckdb

    rows = duckdb.sql("SELECT DISTINCT concat_ws(' ', req_body, req_path, CAST(req_headers AS VARCHAR), CAST(req_query AS VARCHAR)) FROM '/root/testdata/sf0.01/transactions.parquet'").fetchall()
    tables = "\n".join(r[0] for r in rows)
    texts = (*pii_train.PLAIN, *(c for cs in pii_train.CARRIERS.values() for c in cs))
    assert not [part for t in texts for part in re.split(r"\{\w+\}", t) if len(part) >= 12 and part in tables]
