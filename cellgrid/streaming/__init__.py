"""cellgrid.streaming"""
