"""Restarting a query that has failed."""

import logging
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

_LOG = logging.getLogger(__name__)


def supervise(
    start: Callable[[], StreamingQuery],
    tries: int = 5,
    pause: float = 1.0,
    longest_pause: float = 300.0,
    sleep: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Run a query to its end, starting it again after a failure; the query that ended well.

    ``start`` must start the same query with the same checkpoint each time, so that it goes on where the
    last one failed. ``tries`` bounds the failures in a row that finish no micro-batch; each of them
    doubles the pause before the next start, and a finished batch begins the count anew. The last failure
    is raised.
    """
    failed = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException as error:
            # the progress of a failed batch is not reported
            failed = 1 if query.recentProgress else failed + 1
            if failed >= tries:
                raise
            wait = min(longest_pause, pause * 2 ** (failed - 1))
            _LOG.warning("query %s failed (%s of %s), next start in %s s: %s", query.id, failed, tries, wait, error)
            sleep(wait)
