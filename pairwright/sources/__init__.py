"""Tables in and out: corpora, pages, requests, the template catalog, results."""
