"""Contracts that the tests share."""

from stipule import (
    BigDecimal,
    Boolean,
    Contract,
    Double,
    Either,
    Extract,
    Field,
    Int,
    ListOf,
    Long,
    MapOf,
    Nested,
    Rule,
    SetOf,
    String,
    Wrapper,
)
from stipule.functions.checks import no_whitespace

USER = Contract.define(
    "User",
    Field("id", Long, immutable=True, internal=True),
    Field("name", String, non_empty=True, max_length=100),
    Field("email", String, optional=True),
    Field("age", Int, default=0, min=0, max=150),
    Field("password", String, optional=True, masked="***"),
)
ADDRESS = Contract.define("Address", Field("street", String, non_empty=True), Field("city", String, non_empty=True))
PROFILE = Contract.define("Profile", Field("userId", Long, immutable=True), Field("handle", String, non_empty=True, max_length=50), Field("address", Nested(ADDRESS), optional=True))
ITEM = Contract.define("Item", Field("name", String, non_empty=True), Field("qty", Int, min=1))
ORDER = Contract.define("Order", Field("id", String, non_empty=True), Field("items", ListOf(Nested(ITEM)), non_empty=True))
TICKET = Contract.define("Ticket", Field("trackingId", String, default="PENDING", reserved=True), Field("title", String, non_empty=True), Field("notes", String, optional=True))
HOLDER = Contract.define("Holder", Field("label", String), Field("value", Either(String, Int)))
CAT = Contract.define("Cat", Field("name", String, non_empty=True), Field("indoor", Boolean, default=True))
DOG = Contract.define("Dog", Field("name", String, non_empty=True), Field("age", Int, min=1))
PET = Contract.define("Pet", Field("ownerId", String), Field("pet", Either(Nested(CAT), Nested(DOG), key="kind", left_tag="cat", right_tag="dog")))
STAMPS = Contract.define("Stamps", Field("createdAt", Long, immutable=True), Field("updatedAt", Long, default=0))
DOCUMENT = Contract.define("Document", Field("title", String, non_empty=True), Field("body", String, optional=True), Field("stamps", Nested(STAMPS), include=True))
STAY = Contract.define(
    "Stay",
    Field("name", String, non_empty=True),
    Field("checkIn", Int),
    Field("checkOut", Int),
    rules=(Rule("checkOut must be after checkIn", lambda r: r.getField("checkOut") > r.getField("checkIn")),),
)
MEMBER = Contract.define("Member", Field("id", Wrapper("UserId", Long), immutable=True), Field("contact", Wrapper("Email", String), email=True), Field("score", Wrapper("Score", Int), default=0))
BOOKING = Contract.define(
    "Booking",
    Field("day", Extract(r"(\d{4})-(\d{2})-(\d{2})", (("year", Int), ("month", Int), ("day", Int)))),
    Field("code", Extract(r"[A-Z]{2}-\d{4}", (("value", String),)), optional=True),
)
PRODUCT = Contract.define("Product", Field("name", String, non_empty=True), Field("code", String, optional=True, pattern=r"[A-Z]{2}-\d+"), Field("slug", String, validators=(no_whitespace,)))
STORE = Contract.define("Store", Field("warehouseId", String, immutable=True), Field("available", Int, min=0), Field("reserved", Int, min=0), rules=(Rule("reserved beyond available", lambda r: r.getField("reserved") <= r.getField("available")),))
SHELF = Contract.define("Shelf", Field("sku", String, non_empty=True), Field("inventory", Nested(STORE)))
CARD = Contract.define("Card", Field("cardNumber", String, masked="****"), Field("cvv", String, internal=True), Field("amount", Double))
BANK = Contract.define("Bank", Field("accountRef", String, non_empty=True), Field("sortCode", String, internal=True), Field("amount", Double))
INVOICE = Contract.define("Invoice", Field("invoiceId", String), Field("payment", Either(Nested(CARD), Nested(BANK))))
BAGS = Contract.define("Bags", Field("tags", ListOf(String), optional=True), Field("ids", SetOf(Int), optional=True), Field("sizes", MapOf(Double), optional=True), Field("price", BigDecimal, optional=True))
OPEN = Contract.define("Open", Field("key", String), Field("value", String, non_empty=True), open=True)
