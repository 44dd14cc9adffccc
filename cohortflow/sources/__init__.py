"""Sources: canonical tables the engine reads.

Canonical schemas (what every source must provide):

* players      distinct_id, install_date, first_event_time, first_app_version,
               first_platform, first_country, first_mediasource
* events       distinct_id, mp_event_name, res_timestamp (epoch ms), date,
               chapter, dialog_id
* source_names cost_data_name, final_name, media_type
* countries    country_code, is_low_payers_country
* exclusions   distinct_id
"""

from cohortflow.sources.base import EventSource
from cohortflow.sources.catalog import CatalogSource, write_bucketed_events
from cohortflow.sources.frames import FrameSource
from cohortflow.sources.tables import TableSource
from cohortflow.sources.testdata import TestdataSource

__all__ = ["CatalogSource", "EventSource", "FrameSource", "TableSource", "TestdataSource",
           "write_bucketed_events"]
