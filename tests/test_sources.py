"""The broker data source, batch and stream, and HTML tables against the standard parser."""

import json
import random
from html.parser import HTMLParser

import pytest

from barloom.sources import broker_source, brokers, html_tables

ORDERS = [{"order_id": f"o{k}", "symbol": "é" * (k % 5), "side": "buy", "quantity": k / 2, "state": "OPEN" if k % 2 else "filled"} for k in range(50)]


def record(path, rows, mode="w"):
    with open(path, mode) as out:
        out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


@pytest.fixture
def folder(tmp_path):
    record(tmp_path / "gemini.orders.jsonl", ORDERS)
    record(tmp_path / "forex_com.orders.jsonl", ORDERS[:3])
    (tmp_path / "robinhood_crypto.holdings.jsonl").mkdir()
    record(tmp_path / "robinhood_crypto.holdings.jsonl" / "part-0.json", [{"symbol": "BTC", "quantity": 2}, {"symbol": "ETH", "quantity": 0}])
    record(tmp_path / "robinhood_crypto.holdings.jsonl" / "_SUCCESS", [])
    record(tmp_path / "gemini.positions.jsonl", [{"symbol": "BTC", "quantity": 1.5}, {"symbol": "X", "quantity": 0}])
    record(tmp_path / "gemini.accounts.jsonl", [{"currency": "USD", "amount": 7}])
    return tmp_path


@pytest.mark.parametrize("piece", [300, 1 << 20])
def test_pieces_hold_every_line_once(spark, folder, piece):
    brokers.read_broker(spark, str(folder), "orders")
    got = spark.read.format("broker_tables").option("kind", "orders").option("piece_bytes", piece).load(str(folder))
    rows = sorted((r.order_id, r.symbol, r.quantity, r.state) for r in got.where("adapter = 'gemini'").collect())
    assert rows == sorted((r["order_id"], r["symbol"], r["quantity"], r["state"]) for r in ORDERS)
    assert got.count() == 53


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 10_000])
def test_a_piece_begins_and_ends_at_lines(tmp_path, piece):
    lines = ["", "a", "é" * 30, "", "x" * 200, "last"]
    for tail in ("", "\n"):
        text = "\n".join(lines) + tail
        (tmp_path / "f").write_text(text)
        size = len(text.encode())
        got = [x for at in range(0, size, piece) for x in broker_source._lines("", broker_source.Piece("", str(tmp_path / "f"), at, min(at + piece, size)))]
        assert [x.decode() for x in got if x] == [x for x in lines if x]


def test_a_broker_s_files_alone_are_read(spark, folder):
    schema = spark.read.format("broker_tables").option("kind", "orders").load(str(folder)).schema if brokers.read_broker(spark, str(folder), "orders") else None
    options = {"kind": "orders", "path": str(folder), "adapter": "forex_com"}
    assert [p.adapter for p in broker_source.BrokerTables(options).reader(schema).partitions()] == ["forex_com"]
    df = brokers.read_broker(spark, str(folder), "orders")
    # A DataFrame that was filtered once still holds every row.
    assert df.where("adapter = 'forex_com'").count() == 3 and df.count() == 53
    assert brokers.read_broker(spark, str(folder), "orders", "gemini,nobody").count() == 50
    assert brokers.read_broker(spark, str(folder), "orders", "nobody").collect() == [] and brokers.read_broker(spark, str(folder), "fills").collect() == []


def test_odd_lines(spark, tmp_path):
    (tmp_path / "gemini.orders.jsonl").write_text('{"order_id": 5, "quantity": "x"}\nnot json\n[1]\n\n{"order_id": {"a": 1}, "quantity": 3, "more": true}\n{"order_id": "last", "quantity": null}')
    got = [(r.adapter, r.order_id, r.quantity) for r in brokers.read_broker(spark, str(tmp_path), "orders").collect()]
    assert got == [("gemini", None, None), ("gemini", None, None), ("gemini", None, None), ("gemini", '{"a":1}', 3.0), ("gemini", "last", None)]
    for options in ({"kind": "nothing", "path": "/x"}, {"kind": "orders"}):
        with pytest.raises(ValueError):
            broker_source.BrokerTables(options).schema()


def test_stream_reads_on_where_files_grow(spark, folder, tmp_path):
    out, state = str(tmp_path / "_out"), str(tmp_path / "_state")

    def run():
        live = brokers.stream_broker(spark, str(folder), "orders")
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.adapter, r.order_id) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == sorted((r.adapter, r.order_id) for r in brokers.read_broker(spark, str(folder), "orders").collect())
    record(folder / "gemini.orders.jsonl", [{"order_id": "new"}], "a")
    with open(folder / "gemini.orders.jsonl", "a") as file:
        file.write('{"order_id": "half')
    record(folder / "tradingview.orders.jsonl", ORDERS[:1])
    second = run()
    assert sorted(set(second) - set(first)) == [("gemini", "new"), ("tradingview", "o0")] and len(second) == len(first) + 2
    with open(folder / "gemini.orders.jsonl", "a") as file:
        file.write('"}\n')
    assert len(run()) == len(second) + 1


def test_reads_through_the_router(spark, folder):
    asked = [(a, x) for a in ("gemini", "robinhood_crypto", "tradingview", "nobody") for x in (*brokers.READS, "cancel_all_orders", "close_all_positions")]
    rows = brokers.router_reads(spark, str(folder), spark.createDataFrame(asked + asked, "adapter string, action string")).collect()
    status = {(r.adapter, r.action): r.status for r in rows if r.item is None}
    assert len(status) == len(asked) == sum(r.item is None for r in rows)
    items = {}
    for r in rows:
        if r.item is not None:
            assert status[r.adapter, r.action] == r.status == "ok"
            items.setdefault((r.adapter, r.action), []).append(json.loads(r.item))
    assert {s for (a, _), s in status.items() if a == "nobody"} == {"not_registered"}
    assert {s for (a, _), s in status.items() if a == "tradingview"} == {f"{x}_not_supported" for x in (*brokers.READS, "cancel_all_orders", "close_all_positions")}
    assert len(items["gemini", "get_open_orders"]) == 25 and len(items["gemini", "cancel_all_orders"]) == 25
    # A broker without positions shows its holdings, one without balances its accounts.
    assert [x["symbol"] for x in items["robinhood_crypto", "get_positions"]] == ["BTC", "ETH"] and items["gemini", "get_balances"] == [{"currency": "USD", "amount": 7.0}]
    assert items["gemini", "close_all_positions"] == [{"symbol": "BTC", "quantity": 1.5}]
    assert status["robinhood_crypto", "close_all_positions"] == "close_all_positions_not_supported" and status["gemini", "get_recent_fills"] == "get_recent_fills_not_supported"


# --- HTML


class Plain(HTMLParser):
    """Tables by the standard parser: which cells are open is kept as a list of [table, row, cell]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.raw = [], [], False
        self.anchors, self.now = [], None

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        if tag in ("script", "style"):
            self.raw = True
        if tag == "table":
            self.tables.append({"id": first.get("id"), "depth": len(self.open), "rows": []})
            self.open.append([self.tables[-1], None, None])
        elif tag == "tr" and self.open:
            self.open[-1][1:] = [[], None]
            self.open[-1][0]["rows"].append(self.open[-1][1])
        elif tag in ("td", "th") and self.open:
            if self.open[-1][1] is None:
                self.open[-1][1] = []
                self.open[-1][0]["rows"].append(self.open[-1][1])
            self.open[-1][2] = {"text": "", "link": "", "href": None, "in": False}
            self.open[-1][1].append(self.open[-1][2])
        elif tag == "a":
            for _, _, cell in self.open:
                if cell:
                    cell["in"] = cell["href"] is None
                    cell["href"] = first.get("href", "") if cell["in"] else cell["href"]
            self.now = None
            if "href" in first:
                self.now = [first["href"], ""]
                self.anchors.append(self.now)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = False
        if tag == "table" and self.open:
            self.open.pop()
        elif tag == "tr" and self.open:
            self.open[-1][1:] = [None, None]
        elif tag in ("td", "th") and self.open:
            self.open[-1][2] = None
        elif tag == "a":
            self.now = None
            for _, _, cell in self.open:
                if cell:
                    cell["in"] = False

    def handle_data(self, data):
        if self.raw or not data.strip():
            return
        for _, _, cell in self.open:
            if cell:
                cell["text"] += data.strip()
                cell["link"] += data.strip() if cell["in"] else ""
        if self.now is not None:
            self.now[1] += data.strip()


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    rows = [(n, t["id"], t["depth"], k, [(c["text"], None if c["href"] is None else c["link"], c["href"]) for c in row]) for n, t in enumerate(p.tables) for k, row in enumerate(t["rows"])]
    return rows, [(k, href, text) for k, (href, text) in enumerate(p.anchors)]


def test_pages_equal_the_standard_parser(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    html_tables.register(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages_here")
    got = {}
    for r in spark.sql("SELECT page_id, position, href, link FROM pages_here, LATERAL html_links(html)").collect():
        got.setdefault(r.page_id, []).append((r.position, r.href, r.link))
    spark.catalog.dropTempView("pages_here")
    assert got == {i: plain(h)[1] for i, h in pages.items() if plain(h)[1]}


PARTS = [
    "<table>", "<table id=news-table>", "<table class='a b' id='x'>", '<TABLE ID="A&amp;B">', "</table>", "<tr>", "</tr>", "<tr class=odd>", "<td>", "</td>", "<th scope='row'>", "</th>", "<td align=left valign = top>", "<a href='/x?a=1&amp;b=2'>", "<a class=q href=/bare>", '<a href="">',
    "<a name=n>", "</a>", "text ", " é &eacute; &#39;&#x27; &lt;b&gt; ", "&nbsp;&hellip;&copy;", "1 < 2", "a&b", "<b>bold</b>", "<br/>", "<img src=x alt='a>b'>", "<!-- <td>no</td> -->", "<script>var a = '<td>no';</script>", "<style>td{}</style>", "\n \t", "<p title='it&quot;s'>", "</p>", "<td\nid=1\n>",
]


def test_broken_tables_equal_the_standard_parser():
    rng, rows = random.Random(3), 0
    for _ in range(3000):
        html = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        want = plain(html)
        assert (html_tables.table_rows(html), html_tables.links(html)) == want, html
        rows += len(want[0])
    assert rows > 3000


def test_odd_pages_take_linear_time():
    import time

    began = time.time()
    for html in ("<a " * 300_000, "<a href='" * 200_000, "<td x=\"" * 200_000, "<" * 500_000, "<!--" * 300_000, "<table><tr><td>" * 2_000 + "x", "</" * 300_000, "<script>" * 200_000, "&" * 500_000, None, ""):
        html_tables.table_rows(html)
        html_tables.links(html)
    assert time.time() - began < 60
    assert html_tables.table_rows("<td>no table</td>") == [] and html_tables.table_rows("<table><td>a<td>b") == [(0, None, 0, 0, [("a", None, None), ("b", None, None)])]
