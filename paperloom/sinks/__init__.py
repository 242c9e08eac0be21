"""Writers: sheets, log, index, catalogue, dictionary, page archives."""
