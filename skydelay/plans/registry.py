"""All registered queries (importing the modules fills ``REGISTRY``)."""

from skydelay.plans import queries_extra, queries_io, queries_live, queries_ml, queries_requests, queries_schedule, queries_text  # noqa: F401
from skydelay.plans.queries import REGISTRY  # noqa: F401
